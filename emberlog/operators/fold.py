"""Stack traces folded into the line they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.blocks import BLOCK_BITS, SOURCE_KEYS, SUPER_BITS, before, block_of, keyed, with_base
from emberlog.operators.parse import as_lines

MAX_LINES = 50


def is_continuation(text: Column) -> Column:
    """A line that starts with a tab or a space."""
    return F.substring(text, 1, 1).isin(" ", "\t")


def fold(
    lines: DataFrame, max_lines: int = MAX_LINES, cross_source: bool = False, block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Append each continuation line to its head line, at most ``max_lines`` per event.

    A run of continuations longer than that starts a new event at the first line over the limit.  The
    first line of a source is a head even when indented; with ``cross_source`` it can continue the last
    event of the source before.  Only the order of line numbers counts: they may have gaps, as after a filter.

    Lines meet by block of consecutive numbers, never by source, and text moves once.  A block finds the pieces of
    events in it on its own, once it knows how many lines and which last head lie before it; that comes from
    summaries of blocks.  Only the pieces at the two ends of a block may belong to an event that goes on elsewhere,
    and these few meet by event.
    """
    if "line" not in lines.columns:
        raise ValueError("folding needs the order of lines: a column named line")
    lines = keyed(as_lines(lines).select(*SOURCE_KEYS, "line", "text"))
    keys = [] if cross_source else SOURCE_KEYS
    own = [*SOURCE_KEYS, "block"]
    in_order = Window.partitionBy(*own).orderBy("line")
    flagged = lines.withColumns({
        "block": block_of(F.col("line"), block_bits), "_head": ~F.coalesce(is_continuation(F.col("text")), F.lit(False))})
    ranked = flagged.withColumn("_rank", F.row_number().over(in_order)).withColumn(
        "_head_rank", F.max(F.when(F.col("_head"), F.col("_rank"))).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))

    blocks = ranked.groupBy(*own).agg(F.count("*").alias("n"), F.max("_head_rank").alias("_last_head"))
    blocks = with_base(blocks, cross_source).withColumn("_last_head", F.col("base") + F.col("_last_head") - 1)
    # A block holds a line at least, so its base tells it from the others.
    blocks = before(blocks, keys, {"_last_head": "max"}, order="base", run_bits=block_bits + SUPER_BITS)
    step, end = F.lit(max_lines + 1), F.col("base") + F.col("n") - 1
    end_head = F.coalesce("_last_head", "_last_head_before", F.lit(0))
    blocks = blocks.select(*own, "base", "_last_head_before", (end - (end - end_head) % step).alias("_last"))

    at = F.col("base") + F.col("_rank") - 1
    head = F.coalesce(F.col("base") + F.col("_head_rank") - 1, "_last_head_before", F.lit(0))
    # Block rows are few in each partition: hashing them spares the lines a sort by block.
    placed = ranked.join(blocks.hint("shuffle_hash"), own).withColumn("_at", at)
    placed = placed.withColumn("_start", F.col("_at") - (F.col("_at") - head) % step)
    pieces = placed.groupBy(*own, "base", "_last", "_start").agg(
        F.min("_at").alias("_at"), F.min("line").alias("line"), F.collect_list(F.struct("_at", "text")).alias("_parts"))
    at_an_end = (F.col("_start") < F.col("base")) | (F.col("_start") == F.col("_last"))
    whole = pieces.filter(~at_an_end).select(*SOURCE_KEYS, "line", "_parts")
    mended = pieces.filter(at_an_end).groupBy(*keys, "_start").agg(
        F.min_by(F.struct(*SOURCE_KEYS, "line"), "_at").alias("_h"), F.flatten(F.collect_list("_parts")).alias("_parts"))
    events = whole.unionByName(mended.select("_h.*", "_parts"))
    return events.select(
        *SOURCE_KEYS, "line", F.array_join(F.expr("transform(array_sort(_parts), p -> p.text)"), "\n").alias("text"))
