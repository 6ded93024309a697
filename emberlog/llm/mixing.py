"""Sources mixed to target weights by Pareto order sampling.

Every source gets a target in words.  A document is expected ``e`` times, in proportion to its importance and
never above the most copies allowed; the whole part of ``e`` is allotted for certain.  For what is missing the
documents are ranked by ``(u / (1 - u)) / (p / (1 - p))``, their random odds over their inclusion odds, where
``p`` is the broken part of ``e``, and taken in that order up to the target: a sample of fixed size in words.

No source is ever put in order as a whole.  Ranks are cut into bins, words are summed per bin, and only the bin
in which the target is reached is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import checkpoint, text_hash

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2
_SEED = 20_240_229
_BINS, _STRETCH = 4096, 64
# A row of a source takes some hundred bytes; more sources than this are joined by a shuffle that splits hot ones.
_BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Words between ASCII white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES
) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``.

    Sources in code point order, null last, weigh as in ``weights``, over and over.  ``share`` times all words
    are dealt out by weight; what a source cannot take above ``most`` times its size goes to the others by weight.
    Filling up the sources in the order of ``cap / weight`` settles that in one pass.  The windows run over one
    row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("_n", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    ranked = ranked.withColumns({
        "_w": F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int")),
        "_cap": F.col("source_size") * float(most),
    })
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / F.sum("_w").over(after)
    # The first source that is not full sets the level of all behind it.
    filled = ranked.withColumn("_level", level).withColumn("_full", F.col("_level") * F.col("_w") >= F.col("_cap"))
    settled = filled.withColumn("_level", F.min_by(F.when(~F.col("_full"), F.col("_level")), F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), "_n"))).over(Window.partitionBy()))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_level") * F.col("_w"), F.col("_cap")))
    return settled.select("source", "source_size", target.alias("target"))


def _rates(rows: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """``(source, rate)``: expected copies per unit of importance, so that capped copies add up to the target.

    Importance is summed in classes an eighth of an octave wide, a few hundred per source at most, and the rate
    is raised until the documents at the cap stay the same.  It need not be exact: the fixed size of the sample is.
    """
    step = F.floor(F.log2("importance") * 8)
    classes = rows.filter("importance > 0").groupBy("source", step.alias("_c")).agg(
        F.sum("size").cast("double").alias("n"), F.sum(F.col("size") * F.col("importance")).alias("wn"), F.max("importance").alias("w"))
    per = classes.groupBy("source").agg(F.collect_list(F.struct("n", "wn", "w")).alias("_classes"))
    joined = per.join(targets, F.expr("source <=> _source"))
    total = "aggregate(_classes, 0D, (s, c) -> s + IF({keep}, {what}, 0D))"
    capped = total.format(keep=f"c.w * r >= {most}", what="c.n")
    free = total.format(keep=f"c.w * r < {most}", what="c.wn")
    raised = f"IF({free} > 0, greatest(r, (target - {most} * {capped}) / {free}), r)"
    start = "target / " + total.format(keep="true", what="c.wn")
    rate = f"coalesce(aggregate(sequence(1, 24), {start}, (r, i) -> {raised}), 0D)"
    return joined.select("source", F.expr(rate).alias("rate"))


def mix(
    docs: DataFrame, importance: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
    most: int = MOST_COPIES, seed: int = _SEED,
) -> DataFrame:
    """``(doc_id, text_key, source, size, source_size, target, copies, taken)`` per row of ``docs (doc_id, text, source)``.

    ``copies`` says how often the mix takes the document whole, ``taken`` how many words that makes.  ``importance``
    is an expression over ``size``: documents are expected in proportion to it.  The words taken of a source are
    the target but for less than the document that fits the last gap best.

    A null text has no words and is taken no times; null sources form one source; a row without ``doc_id`` is
    drawn by its text.  Random numbers come from ``doc_id`` and text, so reruns agree; repeated rows are
    drawn alike and put in any order, which cannot be told from outside.
    """
    if importance is None:
        importance = F.lit(1.0)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        text_hash(F.col("text")).alias("text_key"), word_count(F.col("text")).alias("size"),
    )
    rows = checkpoint(rows)
    targets = checkpoint(source_targets(rows, weights, share, most))
    weighed = rows.withColumn("importance", F.when(F.col("size") > 0, importance.cast("double")).otherwise(F.lit(0.0)))
    named = targets.withColumnRenamed("source", "_source")
    rates = named.join(_rates(weighed, named, most), F.expr("source <=> _source"), "left").select(
        "_source", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("_rate"))
    # One row per source.  Small enough, it is sent to every task, so that rows of a hot source stay where they are.
    rates = checkpoint(rates)
    if rates.count() <= _BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    u = (F.xxhash64("doc_id", "text_key", F.lit(seed)).bitwiseAND((1 << 52) - 1).cast("double") + 0.5) / float(1 << 52)
    expected = weighed.join(rates, F.expr("source <=> _source")).withColumn(
        "_e", F.least(F.lit(float(most)), F.col("_rate") * F.col("importance")))
    expected = expected.withColumns({"_sure": F.floor("_e"), "_p": F.col("_e") - F.floor("_e"), "_u": u})
    # Ranks are kept as q / (1 + q), which lies between 0 and 1; no inclusion odds rank last.
    odds = (F.col("_u") / (1 - F.col("_u"))) * ((1 - F.col("_p")) / F.col("_p"))
    rank = F.when(F.col("_p") > 0, odds / (1 + odds)).otherwise(F.lit(1.0))
    open_ = (F.col("_sure") < most) & (F.col("size") > 0)
    ranked = checkpoint(expected.select(
        "doc_id", "text_key", "source", "size", "source_size", "target", F.col("_sure").cast("bigint").alias("_sure"),
        F.when(open_, rank).alias("_rank"),
        F.when(open_, F.least(F.floor(rank * _BINS), F.lit(_BINS - 1))).cast("int").alias("_bin"),
    ))
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_s")  # null joins like a name

    sums = ranked.groupBy(key, "_bin").agg(
        F.sum(F.when(F.col("_rank").isNotNull(), F.col("size")).otherwise(F.lit(0))).alias("_words"),
        F.sum(F.col("size") * F.col("_sure")).alias("_certain"), F.first("target").alias("_target"))
    # Bins are summed up in stretches first, so that a source is a window of a few rows on either level.
    sums = sums.withColumn("_stretch", F.floor(F.col("_bin") / _STRETCH))
    whole = Window.partitionBy("_s")
    upto = Window.unboundedPreceding, Window.currentRow
    stretches = sums.groupBy("_s", "_stretch").agg(
        F.sum("_words").alias("_all"), F.sum("_certain").alias("_certain"), F.first("_target").alias("_target"))
    stretches = stretches.withColumn("_gap", F.col("_target") - F.sum("_certain").over(whole)).withColumn(
        "_ahead", F.sum("_all").over(whole.orderBy("_stretch").rowsBetween(*upto)) - F.col("_all"))
    bins = sums.join(stretches.select("_s", "_stretch", "_gap", "_ahead"), ["_s", "_stretch"])
    within = Window.partitionBy("_s", "_stretch").orderBy("_bin").rowsBetween(*upto)
    bins = bins.withColumn("_before", F.col("_ahead") + F.sum("_words").over(within) - F.col("_words")).withColumn("_state", F.expr(
        "CASE WHEN _before + _words <= _gap THEN 1 WHEN _before <= _gap THEN 0 ELSE -1 END"))
    bins = bins.select("_s", F.col("_bin").alias("_b"), "_state", (F.col("_gap") - F.col("_before")).alias("_room"))

    placed = ranked.withColumn("_s", key).join(bins.withColumnRenamed("_s", "_s2"), F.expr("_s = _s2 AND _bin = _b"), "left").drop("_s2", "_b")
    order = ["_rank", "size", "doc_id", "text_key"]
    edge = placed.filter("_state = 0").withColumn(
        "_sum", F.sum("size").over(Window.partitionBy("_s", "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("_in", F.col("_sum") <= F.col("_room"))
    rest = F.max(F.when(F.col("_in"), F.col("_sum")).otherwise(F.lit(0)))
    # One row per source again: sent to every task, or a hot source's untaken documents would all meet their gap in one.
    gaps = checkpoint(edge.groupBy("_s").agg((F.first("_room") - rest).alias("_short")))
    if gaps.count() <= _BROADCAST_SOURCES:
        gaps = F.broadcast(gaps)
    settled = placed.filter("_state IS NULL OR _state <> 0").withColumn("_in", F.coalesce(F.col("_state") == 1, F.lit(False)))
    settled = checkpoint(settled.unionByName(edge.drop("_sum")).withColumn("_more", F.col("_in").cast("bigint")))

    # One more document closes the gap of a source, if there is one that leaves less of it.
    left = settled.filter("_rank IS NOT NULL AND NOT _in").join(gaps, "_s")
    miss = F.abs(F.col("size") - F.col("_short"))
    last = left.filter(miss < F.col("_short")).groupBy("_s").agg(
        F.min(F.struct(miss.alias("miss"), "_rank", "size", "doc_id", "text_key")).alias("_last"))
    last = last.select(F.col("_s").alias("_ls"), F.col("_last.doc_id").alias("_ld"), F.col("_last.text_key").alias("_lk"))
    same = F.expr("_s = _ls AND doc_id <=> _ld AND text_key = _lk AND _rank IS NOT NULL AND NOT _in")
    hits = settled.join(last, same, "left")
    # Repeated rows: only one of them is taken.
    place = F.row_number().over(Window.partitionBy("_ls", "_ld", "_lk").orderBy("_rank"))
    chosen = hits.filter("_ls IS NOT NULL").withColumn("_more", F.when(place == 1, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    done = hits.filter("_ls IS NULL").unionByName(chosen)
    copies = F.col("_sure") + F.col("_more")
    return done.select(
        "doc_id", "text_key", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, importance: Column | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``size, source_size, target, copies, taken``.

    Columns of ``docs`` with one of these names give way.
    """
    own = Window.partitionBy("_key", "_id")
    made = ["size", "source_size", "target", "copies", "taken"]
    counted = mix(docs, importance, **options).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), *made)
    # Repeated rows are told apart by a number, the same on both sides.
    counted = counted.withColumn("_n", F.row_number().over(own.orderBy(F.desc("copies")))).filter("copies > 0")
    rest = [c for c in docs.columns if c.lower() not in made]
    packed = docs.select(
        F.struct(*rest).alias("_row"), F.col("doc_id").cast("bigint").alias("_did"), text_hash(F.col("text")).alias("_dkey"))
    packed = packed.withColumn("_dn", F.row_number().over(Window.partitionBy("_dkey", "_did").orderBy("_did")))
    same = F.expr("_key = _dkey AND _n = _dn AND _id <=> _did")
    return packed.join(counted, same).select("_row.*", *made)
