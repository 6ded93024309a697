"""Stack traces folded in a stream."""

from __future__ import annotations

from itertools import islice
from typing import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberlog.operators.blocks import BLOCK_BITS, SOURCE_KEYS, block_of, keyed
from emberlog.operators.fold import MAX_LINES

_OUT = "source_ord int, source string, line bigint, text string"
# Closed events take a lane by their block, so that they need not pass the task that puts a source's blocks in order.
_ORDERED, _LANES = 0, 256
_PIECE = pa.schema([
    ("source_ord", pa.int32()), ("source", pa.string()), ("lane", pa.int32()), ("line", pa.int64()), ("text", pa.string()),
    ("lead_lines", pa.list_(pa.int64())), ("lead_texts", pa.list_(pa.string())), ("open_line", pa.int64()),
    ("open_text", pa.string()), ("open_count", pa.int32())])
_PIECE_DDL = (
    "source_ord int, source string, lane int, line bigint, text string, lead_lines array<bigint>, lead_texts array<string>,"
    " open_line bigint, open_text string, open_count int")
_ROWS = 4096


def _continues(text: str | None) -> bool:
    return bool(text) and text[0] in " \t"


def _joined(parts: list[str | None]) -> str | None:
    """Lines that are not null, one below the other; null if there is none."""
    parts = [p for p in parts if p is not None]
    return "\n".join(parts) if parts else None


class _Event:
    """The event that the next line may continue."""

    def __init__(self, max_lines: int, line: int | None = None, text: str | None = None, continued: int = 0):
        self.max_lines, self.line, self.continued = max_lines, line, continued
        self.parts = [text]

    def add(self, line: int, text: str | None, continues: bool) -> tuple[int, str] | None:
        """Take in the next line; the event that it closes, if any."""
        if self.line is not None and continues and self.continued < self.max_lines:
            self.parts.append(text)
            self.continued += 1
            return None
        done = self.closed()
        self.line, self.parts, self.continued = line, [text], 0
        return done

    def closed(self) -> tuple[int, str] | None:
        return None if self.line is None else (self.line, _joined(self.parts) or "")


def _block_pieces(source_ord: int, source: str, block: int, lines: list, texts: list, max_lines: int) -> Iterator[dict]:
    """Closed events of a stretch of lines, then its summary: lines before its first head, and its last event, still open."""
    first = next((i for i, t in enumerate(texts) if not _continues(t)), len(texts))
    event, own = _Event(max_lines), {"source_ord": source_ord, "source": source}
    for line, text in zip(lines[first:], texts[first:]):
        if done := event.add(line, text, _continues(text)):
            yield {**own, "lane": 1 + block % _LANES, "line": done[0], "text": done[1]}
    yield {**own, "lane": _ORDERED, "line": lines[0], "lead_lines": lines[:first], "lead_texts": texts[:first],
           "open_line": event.line, "open_text": _joined(event.parts),
           "open_count": event.continued}


def _fold_blocks(max_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One task's share of a batch; a stream cannot be sorted by Spark.
        share = list(batches)
        if not share:
            return
        table = pa.Table.from_batches(share)
        keys = ["source_ord", "source", "block", "line"]
        table = table.take(pc.sort_indices(table, [(k, "ascending") for k in keys])).combine_chunks()

        def pieces() -> Iterator[dict]:
            if not table.num_rows:
                return
            starts = None
            for k in keys[:3]:
                column = table.column(k)
                differs = pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1))
                starts = differs if starts is None else pc.or_(starts, differs)
            cuts = [0, *(i + 1 for i, s in enumerate(starts.to_pylist()) if s), table.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                part = table.slice(low, high - low)
                source_ord, source, block = (part.column(k)[0].as_py() for k in keys[:3])
                yield from _block_pieces(
                    source_ord, source, block, part.column("line").to_pylist(), part.column("text").to_pylist(), max_lines)

        found = pieces()
        while some := list(islice(found, _ROWS)):
            yield pa.RecordBatch.from_pylist(some, schema=_PIECE)

    return run


class _Folder(StatefulProcessor):
    """State per source: the last event, which the next line may still continue.  Other lanes pass through."""

    def __init__(self, max_lines: int, idle_ms: int | None):
        self.max_lines, self.idle_ms = max_lines, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "line bigint, text string, continued int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = (self._named(frame) for frame in rows)
        if key[2] != _ORDERED:
            for frame in frames:
                yield frame[["source_ord", "source", "line", "text"]]
            return
        blocks = pd.concat(list(frames)).sort_values("line")  # one row per block
        held = self.pending.get()
        event = _Event(self.max_lines, *held) if held else _Event(self.max_lines)
        done = []
        for block in blocks.itertuples(index=False):
            done += [event.add(line, text, True) for line, text in zip(block.lead_lines, block.lead_texts)]
            if not pd.isna(block.open_line):
                done.append(event.closed())
                event = _Event(self.max_lines, int(block.open_line), block.open_text, int(block.open_count))
        self.pending.update((int(event.line), _joined(event.parts), int(event.continued)))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._frame(key, [e for e in done if e])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.pending.get()
        self.pending.clear()
        yield self._frame(key, [(held[0], held[1] or "")] if held else [])

    def close(self) -> None:
        pass

    @staticmethod
    def _named(frame: pd.DataFrame) -> pd.DataFrame:
        frame.columns = _PIECE.names  # computed columns arrive without their names
        return frame

    @staticmethod
    def _frame(key, events: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({
            "source_ord": pd.Series([key[0]] * len(events), dtype="int32"),
            "source": pd.Series([key[1]] * len(events), dtype="object"),
            "line": pd.Series([e[0] for e in events], dtype="int64"),
            "text": pd.Series([e[1] for e in events], dtype="object"),
        })


def fold_stream(
    lines: DataFrame, max_lines: int = MAX_LINES, idle_ms: int | None = 5000, block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """As ``fold`` per source, over a stream of lines that arrive in order, batch by batch.

    A batch's lines are folded by block of consecutive numbers, in as many tasks as there are; what a block cannot
    settle (its continuations before the first head, and its last event) is one row, and only these rows of a source
    are put in order.  The state of a source is its open event.  A task holds its share of a batch, so bound a batch
    where much may be waiting.

    The last event of a source waits for its next line; after ``idle_ms`` without one it is emitted as it is.  With
    ``idle_ms=None`` it waits for ever, and a query may end without it.
    """
    lines = keyed(lines.select(*SOURCE_KEYS, "line", "text")).select(
        F.col("source_ord").cast("int").alias("source_ord"), "source", F.col("line").cast("bigint").alias("line"), "text")
    lines = lines.withColumn("block", block_of(F.col("line"), block_bits))
    pieces = lines.repartition(*SOURCE_KEYS, "block").mapInArrow(_fold_blocks(max_lines), _PIECE_DDL)
    return pieces.groupBy(*SOURCE_KEYS, "lane").transformWithStateInPandas(
        _Folder(max_lines, idle_ms), _OUT, "Append", "None" if idle_ms is None else "ProcessingTime")
