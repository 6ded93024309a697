"""Sliding-window admission, idle keys and expiry."""

from __future__ import annotations

from collections import deque
from datetime import datetime, timedelta
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.timestamps import now_column
from emberlog.operators.blocks import before

# Length of a time block, in windows.
_WINDOWS_PER_BLOCK = 4096


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def _segments(instants: DataFrame, window: int) -> DataFrame:
    """Add ``_segment``: the start of the stretch of activity an instant of its key belongs to.

    A pause of at least one window empties the window, so what follows depends on nothing before it.
    Pauses are found inside blocks of time; only block summaries are ordered per key.
    """
    at = F.col("_at")
    instants = instants.withColumn("block", F.floor(at / F.lit(window * _WINDOWS_PER_BLOCK)).cast("bigint"))
    ends = instants.groupBy("_key", "block").agg(F.max("_at").alias("last"))
    instants = instants.join(before(ends, ["_key"], {"last": "max"}).drop("last"), ["_key", "block"])
    in_block = Window.partitionBy("_key", "block").orderBy("_at")
    previous = F.coalesce(F.lag("_at").over(in_block), "last_before")
    fresh = F.when(F.col("_prev").isNull() | (at - F.col("_prev") >= window), at)
    instants = instants.withColumn("_prev", previous).withColumn("_fresh", fresh)
    starts = instants.groupBy("_key", "block").agg(F.max("_fresh").alias("start"))
    carried = before(starts, ["_key"], {"start": "max"}).drop("start")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, 0)
    return instants.join(carried, ["_key", "block"]).select(
        "_key", "_at", "_n", F.coalesce(F.max("_fresh").over(so_far), "start_before").alias("_segment")
    )


def admission(
    events: DataFrame, key: str, ts: str, limit: int, window: timedelta, tie_break: list[str]
) -> DataFrame:
    """Add ``admitted``: fewer than ``limit`` admitted events of the key lie within the window before.

    Rejected events do not count, so each decision depends on the ones before it.  Events of one key at one
    instant are counted together first, with map-side combining; the decisions then run over instants, in
    order, one stretch of activity at a time, and hold at most ``limit`` instants in memory.  A stretch is decided by
    one task, so its length in instants bounds what can run at once.  ``tie_break``
    orders events of the same instant.  A null key is a key like any other; an event without a time is not
    admitted and does not count.
    """
    span = _micros(window)
    # A key in a struct is never null, so it joins and groups whatever it holds.
    numbered = events.withColumns({"_key": F.struct(F.col(key).alias("k")), "_at": F.unix_micros(ts)})
    instants = (
        numbered.filter(F.col("_at").isNotNull())
        .groupBy("_key", F.coalesce("_at", F.lit(0)).alias("_at")).agg(F.count("*").alias("_n"))
    )
    ordered = (
        _segments(instants, span)
        .repartition("_key", "_segment")
        .sortWithinPartitions("_key", "_segment", "_at")
        .select("_key", (F.col("_at") == F.col("_segment")).alias("_new"), "_at", "_n")
    )

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Keys pass through as they are; where a stretch starts is told by a column, never by comparing keys here.
        recent, held = deque(), 0
        for batch in batches:
            granted = []
            for new, at, n in zip(*(batch.column(c).to_pylist() for c in ("_new", "_at", "_n"))):
                if new:
                    recent, held = deque(), 0
                while recent and recent[0][0] <= at - span:
                    held -= recent.popleft()[1]
                taken = max(min(n, limit - held), 0)
                if taken:
                    recent.append((at, taken))
                    held += taken
                granted.append(taken)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("_at"), pa.array(granted, pa.int64())], ["_key", "_at", "_granted"])

    schema = T.StructType([
        ordered.schema["_key"], T.StructField("_at", T.LongType()), T.StructField("_granted", T.LongType())])
    granted = ordered.mapInArrow(decide, schema)
    w = Window.partitionBy("_key", "_at").orderBy(*tie_break)
    return (
        numbered.withColumn("_rank", F.row_number().over(w))
        .join(granted, ["_key", "_at"], "left")
        .select(*events.columns, F.coalesce(F.col("_rank") <= F.col("_granted"), F.lit(False)).alias("admitted"))
    )


def active_keys(admitted: DataFrame, key: str, ts: str, at: datetime | Column, window: timedelta) -> DataFrame:
    """Keys with an admitted event later than ``at - window``, with their last one."""
    cutoff = F.timestamp_micros(F.unix_micros(now_column(at)) - _micros(window))
    return (
        admitted.filter("admitted").groupBy(key).agg(F.max(ts).alias("last_admitted"))
        .filter(F.col("last_admitted") > cutoff)
    )


def idle_expiry(accesses: DataFrame, key: str, ts: str, at: datetime | Column, ttl: timedelta) -> DataFrame:
    """Last access of every key and whether it is still alive: idle for no longer than the time to live."""
    last = F.col("last_access")
    idle = F.unix_micros(now_column(at)) - F.unix_micros(last)
    return accesses.groupBy(key).agg(F.max(ts).alias("last_access")).select(
        key, "last_access", (idle <= _micros(ttl)).alias("alive")
    )
