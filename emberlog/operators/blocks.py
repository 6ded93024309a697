"""Arrival order without a global sort: blocks of consecutive lines and prefix values over them.

A source may hold most of all lines, so nothing here gathers a source in one task.  Lines are cut into
blocks of consecutive numbers, each block is summed up on its own, and only the block summaries (one row
per block) are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.session import scratch_dir

BLOCK_BITS = 16
SUPER_BITS = 12
_MERGE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}

SOURCE_KEYS = ["source_ord", "source"]


def keyed(lines: DataFrame) -> DataFrame:
    """Lines whose source and number cannot be null.

    With nullable keys each use of a summary of the lines gets null checks of its own; without them the
    summary is planned the same everywhere, and its exchange computed once and reused.
    """
    known = {"source_ord": F.lit(0), "source": F.lit(""), "line": F.lit(0).cast("bigint")}
    return lines.withColumns({c: F.coalesce(c, default) for c, default in known.items()})


def block_of(ordinal: Column, bits: int = BLOCK_BITS) -> Column:
    return F.shiftright(ordinal.cast("bigint"), bits)


def before(
    blocks: DataFrame, keys: list[str], values: dict[str, str], order: str = "block", run_bits: int = SUPER_BITS
) -> DataFrame:
    """Add ``<name>_before`` per value: its sum, max or min over all earlier blocks of the same keys.

    ``values`` maps a column to ``sum``, ``max`` or ``min``.  Two levels keep every window short: blocks
    within a run, whose ``order`` agrees above the lowest ``run_bits``, and the runs of a key.
    """
    run = F.shiftright(order, run_bits).alias("_run")
    runs = blocks.groupBy(*keys, run).agg(*[getattr(F, how)(v).alias(v) for v, how in values.items()])
    w_run = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "_run", *[getattr(F, how)(v).over(w_run).alias(f"_{v}_r") for v, how in values.items()])
    w_in = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = blocks.withColumn("_run", run).withColumns(
        {f"_{v}_b": getattr(F, how)(v).over(w_in) for v, how in values.items()}
    )
    return inner.join(runs, [*keys, "_run"]).select(
        *blocks.columns,
        *[_MERGE[how](F.col(f"_{v}_r"), F.col(f"_{v}_b")).alias(f"{v}_before") for v, how in values.items()],
    )


def block_offsets(lines: DataFrame, across_sources: bool = False, bits: int = BLOCK_BITS) -> DataFrame:
    """``(source_ord, source, block, n, base)`` of every block of lines.

    ``base`` counts the lines before the block: in its source, or in all earlier sources as well.  Lines
    should be ``keyed``.
    """
    counts = lines.groupBy(*SOURCE_KEYS, block_of(F.col("line"), bits).alias("block")).agg(F.count("*").alias("n"))
    return with_base(counts, across_sources)


def with_base(counts: DataFrame, across_sources: bool = False) -> DataFrame:
    """Add ``base`` to blocks with their number of lines ``n``; other columns stay."""
    out = before(counts, SOURCE_KEYS, {"n": "sum"}).withColumnRenamed("n_before", "base")
    out = out.withColumn("base", F.coalesce("base", F.lit(0)))
    if not across_sources:
        return out
    # One row per source: the only table here whose order is settled in a single task.
    w = Window.orderBy(*SOURCE_KEYS).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.groupBy(*SOURCE_KEYS).agg(F.sum("n").alias("_n")).select(
        *SOURCE_KEYS, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset")
    )
    return out.join(offsets, SOURCE_KEYS).withColumn("base", F.col("base") + F.col("_offset")).select(*out.columns)


def with_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """The rows with their rank from 1 in an order, which must not leave ties.

    Rows are sorted by ranges and written once to the scratch folder; a rank is the place in a range after those before,
    of which there is one row each.
    """
    path = scratch_dir(df.sparkSession)
    ordered = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    ordered.write.parquet(path)
    # The number of the range is above bit 33, the place in it below.
    rows = df.sparkSession.read.schema(ordered.schema).parquet(path).withColumns({
        "_range": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND((1 << 33) - 1)})
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(before, "_range").select((F.col("_before") + F.col("_place") + 1).alias(name), *df.columns)
