"""Events in arrival order: the first ones, and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.blocks import BLOCK_BITS, SOURCE_KEYS, block_of, block_offsets, keyed

PAGE = 100
MAX_LIMIT = 1000
FIRST = 10

ARRIVAL = [*SOURCE_KEYS, "line"]


def first_n(events: DataFrame, n: int = FIRST) -> DataFrame:
    """The first n events in arrival order; 0 keeps them all."""
    ordered = events.orderBy(*ARRIVAL)
    return ordered.limit(n) if n > 0 else ordered


def clamp_limit(limit: int) -> int:
    """Limit of an analysis request: 10 when below 1, at most 1000."""
    return FIRST if limit < 1 else min(limit, MAX_LIMIT)


def page_bounds(offset: int | None, limit: int | None) -> tuple[int, int]:
    """Offset and limit of a page request, defaults in place of values out of range."""
    return (
        offset if offset is not None and offset >= 0 else 0,
        limit if limit is not None and 1 <= limit <= MAX_LIMIT else PAGE,
    )


def page(events: DataFrame, offset: int | None = 0, limit: int | None = PAGE, bits: int = BLOCK_BITS) -> DataFrame:
    """Events ``offset`` to ``offset + limit`` in arrival order; none beyond the end.

    The rows before a page are skipped block by block: blocks are counted, and only the few that reach into the page
    are numbered and sorted, however far down it lies.
    """
    return page_and_count(events, offset, limit, bits)[0]


def page_with_total(
    events: DataFrame, offset: int | None = 0, limit: int | None = PAGE, bits: int = BLOCK_BITS
) -> DataFrame:
    """A page with the number of all events in column ``total``, which comes from the same counts of blocks."""
    rows, total = page_and_count(events, offset, limit, bits)
    return rows.withColumn("total", total.scalar())


def page_and_count(
    events: DataFrame, offset: int | None = 0, limit: int | None = PAGE, bits: int = BLOCK_BITS
) -> tuple[DataFrame, DataFrame]:
    """A page, and one row with the number of all events; rows need ``source_ord, source, line`` only."""
    offset, limit = page_bounds(offset, limit)
    events = keyed(events)
    offsets = block_offsets(events, across_sources=True, bits=bits)
    total = offsets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    # Every block holds an event, so at most ``limit`` blocks reach into the page.
    wanted = offsets.filter((F.col("base") < offset + limit) & (F.col("base") + F.col("n") > offset)).limit(limit)
    w = Window.partitionBy(*SOURCE_KEYS, "block").orderBy("line")
    rows = (
        events.withColumn("block", block_of(F.col("line"), bits))
        .join(F.broadcast(wanted.drop("n")), [*SOURCE_KEYS, "block"])
        .withColumn("_at", F.col("base") + F.row_number().over(w) - 1)
        .filter(F.col("_at").between(offset, offset + limit - 1))
        .select(*events.columns)
        .orderBy(*ARRIVAL)
    )
    return rows, total
