"""Sliding-window admission in a stream."""

from __future__ import annotations

from bisect import insort
from collections import deque
from datetime import timedelta
from typing import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _Gate(StatefulProcessor):
    """State per key: the admitted times still inside the window, at most ``limit`` of them."""

    def __init__(self, columns: list[str], ts: str, limit: int, window: int, order: list[str], ttl_ms: int | None):
        self.columns, self.ts, self.order = columns, ts, order
        self.limit, self.window, self.ttl_ms = limit, window, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "times array<bigint>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.recent.get()
        recent = deque(held[0] if held else [])  # oldest first
        frame = pd.concat(list(rows))
        frame.columns = self.columns  # computed columns arrive without their names
        frame["_at"] = frame[self.ts].astype("datetime64[us]").astype("int64")
        frame = frame.sort_values(["_at", *self.order])
        admitted = []
        for at in frame["_at"]:
            while recent and recent[0] <= at - self.window:
                recent.popleft()
            admitted.append(len(recent) < self.limit)
            if admitted[-1]:
                insort(recent, int(at))  # in order even when an event comes late
        self.recent.update((list(recent),))
        yield frame.drop(columns="_at").assign(admitted=admitted)

    def close(self) -> None:
        pass


class _OrderedGate(StatefulProcessor):
    """State per group of keys: its events that the watermark has not passed, in frames as they came, and the admitted times.

    A timer of event time stands at the group's earliest waiting event; when the watermark passes it, all events before the
    watermark are decided in order, key by key.  A group without waiting events keeps a timer for the end of its last
    window, which ends its state.
    """

    def __init__(self, columns: list[str], key: str, ts: str, limit: int, window: int, order: list[str]):
        self.columns, self.key, self.ts, self.limit, self.window, self.order = columns, key, ts, limit, window, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "frame binary")
        self.waiting = handle.getListState("waiting", "frame binary")

    def _times(self, frame: pd.DataFrame) -> pd.Series:
        return frame[self.ts].astype("datetime64[us]").astype("int64")

    def _keep(self, frame: pd.DataFrame) -> None:
        for at in range(0, len(frame), _FRAME_ROWS):
            self.waiting.appendValue((_packed(frame.iloc[at : at + _FRAME_ROWS]),))

    def _wake_at(self, moment: int, fired: int | None = None) -> None:
        """One timer per group, at the earliest moment asked for, in microseconds; the one that just fired does not count."""
        ms, held = moment // 1000, [t for t in self.handle.listTimers() if t != fired]
        if any(t <= ms for t in held):
            return
        for t in held:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(ms, 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            frame.columns = self.columns  # computed columns arrive without their names
            self._keep(frame)
            least = int(self._times(frame).min())
            first = least if first is None else min(first, least)
        if first is not None:
            self._wake_at(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, fired = timerValues.getCurrentWatermarkInMs() * 1000, expiredTimerInfo.getExpiryTimeInMs()
        held = self.recent.get()
        recent = _unpacked(held[0]) if held else pd.DataFrame({self.key: [], "_at": []})  # oldest first
        frames = [_unpacked(f[0]) for f in self.waiting.get()]
        self.waiting.clear()
        ready = None
        if frames:
            frame = pd.concat(frames, ignore_index=True)
            frame["_at"] = self._times(frame)
            late = frame["_at"] >= passed
            if late.any():
                rest = frame[late]
                self._keep(rest.drop(columns="_at"))
                self._wake_at(int(rest["_at"].min()), fired)
            ready = frame[~late]
        if ready is not None and len(ready):
            keys = pd.concat([recent[self.key], ready[self.key]], ignore_index=True) if len(recent) else ready[self.key]
            codes = pd.factorize(keys, use_na_sentinel=False)[0]
            times: dict[int, deque] = {}
            for code, at in zip(codes[: len(recent)].tolist(), recent["_at"].tolist()):
                times.setdefault(code, deque()).append(at)
            ready = ready.assign(_code=codes[len(recent) :]).sort_values(["_code", "_at", *self.order])
            admitted, last, own = [], None, deque()
            for code, at in zip(ready["_code"].tolist(), ready["_at"].tolist()):
                if code != last:
                    last, own = code, times.pop(code, None) or deque()
                while own and own[0] <= at - self.window:
                    own.popleft()
                admitted.append(len(own) < self.limit)
                if admitted[-1]:
                    own.append(at)
            ready = ready.assign(admitted=admitted)
            yield ready.drop(columns=["_at", "_code"])
            recent = pd.concat([part for part in (recent, ready.loc[ready["admitted"], [self.key, "_at"]]) if len(part)])
        # Later events come at the watermark or after it.
        recent = recent[recent["_at"] > passed - self.window]
        if len(recent):
            self.recent.update((_packed(recent),))
            self._wake_at(int(recent["_at"].max()) + self.window + 1000, fired)
        else:
            self.recent.clear()

    def close(self) -> None:
        pass


# Rows of a frame in the state, at most.
_FRAME_ROWS = 1 << 16


def _packed(frame: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(frame: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(frame)).read_pandas()


def admission_stream(
    events: DataFrame, key: str, ts: str, limit: int, window: timedelta, tie_break: list[str],
    idle_ttl: timedelta | None = None, lateness: timedelta | None = None, groups: int = 1024,
) -> DataFrame:
    """As ``admission``, over events that arrive in order; a key's state ends after ``idle_ttl`` without an event.

    With ``lateness`` events may arrive in any order up to so much behind the latest one.  They wait until the
    watermark has passed them and get the decisions that ``admission`` makes; a key's state ends with its last window.
    Events that come later still are dropped by the watermark, and the last events of a stream wait for later ones.
    ``ts`` must not be null then.  Keys are dealt by hash over ``groups``, each with one state and one timer: a call of Python and
    its requests to the state cost more than the decisions of a key.  A group's waiting events are held in a task's memory.

    Without it a key's events are decided as they come.  The time to live runs by the clock, so it must not be shorter than the window, or a key's events would be
    forgotten while they count.  A stream that runs on needs one; without it keys are kept for ever, which suits a
    stream that ends, as one with a time to live never does (``availableNow`` waits for its timers).
    """
    if idle_ttl is not None and idle_ttl < window:
        raise ValueError("a key's state must live as long as the window")
    micros = window // timedelta(microseconds=1)
    ttl_ms = None if idle_ttl is None else idle_ttl // timedelta(milliseconds=1)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    if lateness is not None:
        late = events.withWatermark(ts, f"{lateness // timedelta(milliseconds=1)} milliseconds")
        # pandas makes doubles of whole numbers with nulls among them, so nulls travel in columns of their own.
        nulls = {f.name: f"_null{i}" for i, f in enumerate(events.schema.fields) if isinstance(f.dataType, T.IntegralType)}
        filled = [F.coalesce(c, F.lit(0)).cast(events.schema[c].dataType).alias(c) if c in nulls else F.col(c) for c in events.columns]
        # Events without a key are a group of their own.
        group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")).alias("_group")
        late = late.select(*filled, *[F.col(c).isNull().alias(n) for c, n in nulls.items()], group)
        order = [x for c in tie_break for x in ([nulls[c], c] if c in nulls else [c])]
        ordered = _OrderedGate(late.columns, key, ts, limit, micros, order)
        flags = "".join(f"`{n}` boolean, " for n in nulls.values())
        decided = late.groupBy("_group").transformWithStateInPandas(
            ordered, f"{fields}, {flags}_group int, admitted boolean", "Append", "EventTime")
        back = [F.when(~F.col(nulls[c]), F.col(c)).alias(c) if c in nulls else F.col(c) for c in events.columns]
        return decided.select(*back, "admitted")
    gate = _Gate(events.columns, ts, limit, micros, tie_break, ttl_ms)
    return events.groupBy(key).transformWithStateInPandas(
        gate, f"{fields}, admitted boolean", "Update", "ProcessingTime" if ttl_ms else "None")
