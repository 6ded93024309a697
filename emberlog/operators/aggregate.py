"""Counts, time ranges, error groups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import levels as lv
from emberlog.functions.clock import percent
from emberlog.functions.normalize import with_signature
from emberlog.operators.blocks import with_rank

TOP = 10
EXACT, FIRST_K = "exact", "first_k"

# Alphabetical, the order of keys in a serialized report.
_NAMES = sorted(lv.RANKS)

# Arrival as one number: sources are this far apart, farther than a line number goes.
_SOURCE_STEP = "10000000000000000000BD"
_ARRIVAL_NUMBER = (
    f"cast(cast(source_ord AS decimal(10,0)) * {_SOURCE_STEP} + cast(line AS decimal(19,0)) AS decimal(38,0))"
)

GROUP_FIELDS = ["signature", "sample", "count", "first_seen", "last_seen"]


def _count_of(name: str) -> Column:
    return F.count_if(F.col("level") == lv.RANKS[name])


def total_lines(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total_lines"))


def level_counts(events: DataFrame) -> DataFrame:
    """Events per level, for the levels that occur."""
    return events.groupBy("level_name").agg(F.count("*").alias("count"))


def level_shares(counts: DataFrame, total: str = "total_lines", levels: str = "levels") -> DataFrame:
    """Five rows per report: ``level, count, pct, pct1`` with shares of all events in percent, two and one decimals.

    ``levels`` is a map column; the report's other columns are kept.
    """
    whole = F.greatest(F.col(total), F.lit(1))
    names = F.array(*[F.lit(n) for n in lv.BY_SEVERITY])
    kept = [c for c in counts.columns if c not in (total, levels)]
    rows = counts.select(*kept, F.col(total), F.col(levels), F.posexplode(names).alias("severity", "level"))
    count = F.coalesce(F.try_element_at(F.col(levels), F.col("level")), F.lit(0))
    return rows.select(
        *kept, "severity", "level", count.alias("count"),
        percent(count, whole, 2).alias("pct"), percent(count, whole, 1).alias("pct1"),
    )


def level_chart(counts: DataFrame, levels: str = "levels") -> DataFrame:
    """Levels that occur, most severe first, with their share of the levels' sum."""
    total = F.aggregate(F.map_values(levels), F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = level_shares(counts.select(F.col(levels).alias("levels"), total.alias("total_lines")))
    return rows.filter(F.col("count") > 0).select("severity", "level", "count", F.col("pct1").alias("pct"))


def time_range(events: DataFrame) -> DataFrame:
    """First and last timestamp and the whole seconds between them."""
    return events.agg(F.min("ts").alias("first_line"), F.max("ts").alias("last_line")).withColumn(
        "duration_sec", duration_sec(F.col("first_line"), F.col("last_line"))
    )


def duration_sec(first: Column, last: Column) -> Column:
    return F.floor((F.unix_micros(last) - F.unix_micros(first)) / 1_000_000)


def stat_cards(events: DataFrame) -> DataFrame:
    """Total, errors, warnings and infos in one row."""
    return events.agg(
        F.count("*").alias("total"), _count_of("ERROR").alias("errors"),
        _count_of("WARN").alias("warnings"), _count_of("INFO").alias("infos"),
    )


def _arrival() -> Column:
    return F.struct("source_ord", "line", "ts", "message")


def error_groups(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Errors and worse by signature: count, first arrival's message and time, latest time.

    ``first_seen`` is the time of the event that arrived first, even when it has none, not the earliest.
    """
    by = by or []
    return (
        with_signature(events.filter(F.col("level") >= lv.ERROR))
        .groupBy(*by, "signature")
        .agg(F.count("*").alias("count"), F.max("ts").alias("last_seen"), F.min(_arrival()).alias("_first"))
        .select(
            *by, "signature", F.col("_first.message").alias("sample"), "count",
            F.col("_first.ts").alias("first_seen"), "last_seen",
            F.struct("_first.source_ord", "_first.line").alias("arrival"),
        )
    )


def top_errors(events: DataFrame, k: int = TOP, mode: str = EXACT) -> DataFrame:
    """The k largest error groups, largest first; 0 means all of them, a negative k none.

    ``first_k`` keeps the k signatures that arrived first instead.  Equal counts go by signature.
    """
    groups = error_groups(events)
    if k < 0:
        groups = groups.limit(0)
    elif k > 0 and mode == FIRST_K:
        groups = groups.orderBy("arrival").limit(k)
    ordered = groups.orderBy(F.desc("count"), "signature")
    return (ordered.limit(k) if k > 0 else ordered).select(*GROUP_FIELDS)


def ranked_groups(events: DataFrame, mode: str = EXACT) -> DataFrame:
    """All error groups with their ``rank`` from 1 in the order of ``top_errors``: the table beside a report that holds none.

    No number of groups meets in one row or task.
    """
    order = ["arrival"] if mode == FIRST_K else [F.desc("count"), "signature"]
    return with_rank(error_groups(events), order).select("rank", *GROUP_FIELDS)


def report_and_groups(
    events: DataFrame, mode: str = EXACT, source: str = "stdin", sources: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """A report without error groups, and all groups as a ranked table: what ``report`` with ``k=0`` says, at any size."""
    return report(events, -1, mode, None, source, sources), ranked_groups(events, mode)


def report_groups(events: DataFrame, by: str | None = None, with_total: bool = False) -> DataFrame:
    """Events summed up per signature, all non-errors under one null signature.

    One pass over the events; everything a report holds follows from these rows, so they can be a stream's state.
    ``with_total`` adds one row over all events (without ``by``), for which ``whole`` is true.
    """
    counts = [f"count_if(level = {lv.RANKS[n]}) AS {n}" for n in _NAMES]
    first = f"min(CASE WHEN level >= {lv.ERROR} THEN struct(source_ord, line, ts, message) END) AS first"
    # Only errors carry their message into the aggregation.
    errors_only = F.when(F.col("level") >= lv.ERROR, F.col("message"))
    signed = with_signature(events.withColumn("message", errors_only))
    sums = [*map(F.expr, ["count(*) AS n", *counts, "min(ts) AS first_ts", "max(ts) AS last_ts", first])]
    if with_total:
        signed = signed.withColumn("whole", F.explode(F.array(F.lit(False), F.lit(True))))
        signed = signed.withColumn("signature", F.when(~F.col("whole"), F.col("signature")))
        return signed.groupBy("whole", "signature").agg(*sums)
    return signed.groupBy(*([by] if by else []), "signature").agg(*sums)


def _tallies(events: DataFrame, by: str | None) -> DataFrame:
    """As ``report_groups`` without message and time of the first arrival, which ``first`` only names.

    All buffers have a fixed width, so the lines are hashed into their groups and never sorted.
    """
    counts = [f"count_if(level = {lv.RANKS[n]}) AS {n}" for n in _NAMES]
    arrival = f"min(CASE WHEN level >= {lv.ERROR} THEN {_ARRIVAL_NUMBER} END) AS _arrival"
    errors_only = F.when(F.col("level") >= lv.ERROR, F.col("message"))
    grouped = (
        with_signature(events.withColumn("message", errors_only))
        .groupBy(*([by] if by else []), "signature")
        .agg(*map(F.expr, ["count(*) AS n", *counts, "min(ts) AS first_ts", "max(ts) AS last_ts", arrival]))
    )
    first = (
        f"named_struct('source_ord', cast(_arrival div {_SOURCE_STEP} AS int), 'line', cast(_arrival % {_SOURCE_STEP} AS bigint),"
        " 'ts', cast(NULL AS timestamp), 'message', cast(NULL AS string)) AS first"
    )
    return grouped.selectExpr("*", first).drop("_arrival")


def report(
    events: DataFrame, k: int = TOP, mode: str = EXACT, by: str | None = None,
    source: str = "stdin", sources: list[str] | None = None,
) -> DataFrame:
    """One report over all events, or one per value of ``by``, which is then its source label.

    ``sources`` are all inputs the report names, ``source`` the first.  ``k`` and ``mode`` choose the error
    groups as in ``top_errors``; with ``k=0`` a report holds all of them in one row, so take ``report_and_groups``
    where there may be many.

    Events are counted in one hash aggregation.  Only the best groups' first messages are fetched afterwards, by
    line number: that join sits below the parsing, so no other line is parsed again.
    """
    label = F.col(by).cast("string") if by else F.lit(source)
    best = _reports(_tallies(events, by), k, mode, by, source, sources)
    # Handed on whole, so that both uses below read one and the same aggregation.
    fields = ", ".join(f"'{c}', {c}" for c in best.columns)
    best = best.selectExpr(f"inline(array(named_struct({fields})))")
    wanted = best.select(F.col("source").alias("_label"), F.posexplode("top_errors").alias("_place", "_g"))
    wanted = wanted.select("_label", "_place", "_g", F.col("_g.source_ord").alias("_ord"), F.col("_g.line").alias("_line"))
    places = wanted.select("_ord", "_line")
    candidates = events.join(places, (F.col("source_ord") == F.col("_ord")) & (F.col("line") == F.col("_line")), "left_semi")
    candidates = with_signature(candidates.filter(F.col("level") >= lv.ERROR)).select(
        label.alias("_l2"), "signature", "source_ord", "line", F.struct("ts", "message").alias("_sample"))
    same = (
        F.col("_label").eqNullSafe(F.col("_l2")) & (F.col("_g.signature") == F.col("signature"))
        & (F.col("_ord") == F.col("source_ord")) & (F.col("_line") == F.col("line"))
    )
    filled = wanted.join(candidates, same).groupBy("_label", "_place", "_g").agg(F.min("_sample").alias("_sample"))
    top = filled.groupBy("_label").agg(F.array_sort(F.collect_list(F.struct(
        "_place", F.col("_g.signature").alias("signature"), F.col("_sample.message").alias("sample"),
        F.col("_g.count").alias("count"), F.col("_sample.ts").alias("first_seen"), F.col("_g.last_seen").alias("last_seen"),
    ))).alias("_top"))
    fields = ", ".join(f"g.{f} AS {f}" for f in GROUP_FIELDS)
    none = "cast(array() AS array<struct<signature: string, sample: string, count: bigint, first_seen: timestamp, last_seen: timestamp>>)"
    joined = best.join(top, F.col("source").eqNullSafe(F.col("_label")), "left")
    return joined.select(
        "source", "sources", "total_lines", "levels",
        F.expr(f"coalesce(transform(_top, g -> struct({fields})), {none}) AS top_errors"), "first_line", "last_line",
    )


def report_of_groups(
    grouped: DataFrame, k: int = TOP, mode: str = EXACT, by: str | None = None,
    source: str = "stdin", sources: list[str] | None = None,
) -> DataFrame:
    """Reports from the rows of ``report_groups``."""
    reports = _reports(grouped, k, mode, by, source, sources)
    fields = ", ".join(f"g.{f} AS {f}" for f in GROUP_FIELDS)
    return reports.withColumn("top_errors", F.expr(f"transform(top_errors, g -> struct({fields}))"))


def _reports(
    grouped: DataFrame, k: int, mode: str, by: str | None, source: str, sources: list[str] | None
) -> DataFrame:
    """Reports whose error groups have the place of their first arrival besides.

    The best groups of a report are picked in shares first, as many as the session's shuffle partitions, so neither
    many signatures nor one large report meet in one task; the last step holds k groups per share at most.
    """
    keys = [by] if by else []
    shares = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rank = "struct(first.source_ord, first.line)" if mode == FIRST_K else "struct(-n AS a, signature AS b)"
    ranked = grouped.selectExpr(
        "*", f"pmod(xxhash64(signature), {shares}) AS share", f"{rank} AS rank",
    )
    if k > 0:
        within = ", ".join([*keys, "share"])
        place = f"row_number() OVER (PARTITION BY {within} ORDER BY signature IS NULL, rank)"
        ranked = ranked.selectExpr("*", f"{place} AS place")
    kept = "signature IS NOT NULL" + (" AND place <= " + str(k) if k > 0 else "")
    group = (
        "struct(rank, signature, first.message AS sample, n AS count, first.ts AS first_seen, last_ts AS last_seen,"
        " first.source_ord AS source_ord, first.line AS line)"
    )
    sums = [f"sum({c}) AS {c}" for c in ["n", *_NAMES]]
    ends = ["min(first_ts) AS first_ts", "max(last_ts) AS last_ts"]
    per_share = ranked.groupBy(*keys, "share").agg(
        *map(F.expr, [*sums, *ends, f"collect_list(CASE WHEN {kept} THEN {group} END) AS best"])
    )
    totals = per_share.groupBy(*keys).agg(*map(F.expr, [*sums, *ends, "flatten(collect_list(best)) AS best"]))

    best = "array_sort(best)"
    if k != 0:
        best = f"slice({best}, 1, {max(k, 0)})"
    held = [*GROUP_FIELDS, "source_ord", "line"]
    if mode == FIRST_K:
        fields = ", ".join(f"g.{f} AS {f}" for f in held)
        best = f"array_sort(transform({best}, g -> struct(struct(-g.count AS a, g.signature AS b) AS rank, {fields})))"
    top = f"transform({best}, g -> struct({', '.join(f'g.{f} AS {f}' for f in held)}))"
    counts = ", ".join(f"struct('{n}' AS level, {n} AS count)" for n in _NAMES)
    label = F.col(by).cast("string") if by else F.lit(source)
    all_sources = F.array(label) if by or sources is None else F.array(*[F.lit(s) for s in sources])
    return totals.select(
        label.alias("source"), all_sources.alias("sources"), F.expr("coalesce(n, 0) AS total_lines"),
        F.expr(f"map_from_entries(filter(array({counts}), c -> c.count > 0)) AS levels"),
        F.expr(f"{top} AS top_errors"), F.col("first_ts").alias("first_line"), F.col("last_ts").alias("last_line"),
    )


def report_rollup(reports: DataFrame) -> DataFrame:
    """Number of reports, of complete ones, and their lines and errors.  Without ``status`` all are complete."""
    done = F.col("status") == "complete" if "status" in reports.columns else F.lit(True)
    errors = sum((F.coalesce(F.try_element_at("levels", F.lit(n)), F.lit(0)) for n in ("ERROR", "FATAL")), F.lit(0))
    return reports.agg(
        F.count("*").alias("reports"), F.count_if(done).alias("complete"),
        F.coalesce(F.sum(F.when(done, F.col("total_lines"))), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum(F.when(done, errors)), F.lit(0)).alias("total_errors"),
    )


def observe_progress(events: DataFrame, matched: Column, name: str | Observation = "progress") -> DataFrame:
    """Count parsed and matched events while they pass through; read as the query's observed metrics.

    With an ``Observation`` in place of a name the counts of one action can be had as rows.
    """
    return events.observe(name, F.count("*").alias("parsed"), F.count_if(matched).alias("matched"))


def progress_rows(spark: SparkSession, seen: Observation) -> DataFrame:
    """``(parsed, matched)`` as observed by the action that has run; waits for it to end."""
    return spark.createDataFrame([seen.get], "parsed bigint, matched bigint")
