"""Reports as JSON, CSV rows, text and prompts; one output row per report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import levels as lv
from emberlog.functions.clock import (
    ZERO_MOMENT_TEXT, display_time, long_duration, percent, rfc3339, rfc3339_or_zero, time_of_day,
)
from emberlog.operators.aggregate import GROUP_FIELDS, duration_sec, level_shares

READ_SCHEMA = (
    "source string, total_lines bigint, levels map<string,bigint>, "
    "top_errors array<struct<signature:string,sample:string,count:bigint,first_seen:timestamp,last_seen:timestamp>>, "
    "first_line timestamp, last_line timestamp"
)

# The wording of a summary prompt.
PROMPT_TASK = (
    "You are a log analysis assistant. Given the following log summary, identify root causes, impacted "
    "components, and recommend next steps. Be concise (2-4 paragraphs)."
)
# The order of levels in a text report.
TEXT_ORDER = ("ERROR", "WARN", "INFO", "DEBUG", "FATAL")


def escape_html(json: Column) -> Column:
    """Angle brackets and ampersands of a JSON text as escapes, the way web-safe encoders write them."""
    for char, code in (
        ("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029"),
    ):
        json = F.replace(json, F.lit(char), F.lit(code))
    return json


def _json_groups() -> Column:
    groups = F.transform("top_errors", lambda g: F.struct(
        *[g[f].alias(f) for f in GROUP_FIELDS[:3]],
        rfc3339_or_zero(g["first_seen"]).alias("first_seen"), rfc3339_or_zero(g["last_seen"]).alias("last_seen"),
    ))
    return F.when(F.size("top_errors") > 0, groups).alias("top_errors")


def report_json(reports: DataFrame) -> DataFrame:
    """``json``: source, total_lines, time_range (left out without timestamps), levels, top_errors (if any)."""
    span = F.struct(
        rfc3339(F.col("first_line")).alias("first"), rfc3339(F.col("last_line")).alias("last"),
        duration_sec(F.col("first_line"), F.col("last_line")).alias("duration_sec"),
    )
    body = F.struct(
        "source", "total_lines", F.when(F.col("first_line").isNotNull(), span).alias("time_range"),
        "levels", _json_groups(),
    )
    return reports.select(escape_html(F.to_json(body)).alias("json"))


def report_document(reports: DataFrame) -> DataFrame:
    """``json`` in the shape an analysis service answers with; read back by ``read_report``."""
    body = F.struct(
        "source", F.when(F.size("sources") > 0, F.col("sources")).alias("sources"), "total_lines",
        "levels", _json_groups(),
        rfc3339_or_zero(F.col("first_line")).alias("first_line"), rfc3339_or_zero(F.col("last_line")).alias("last_line"),
    )
    return reports.select(escape_html(F.to_json(body)).alias("json"))


def read_report(documents: DataFrame, column: str = "json") -> DataFrame:
    """Reports from their JSON: level names that are not known count as INFO, the source list is not read."""
    r = F.from_json(column, READ_SCHEMA)
    zero = F.to_timestamp(F.lit(ZERO_MOMENT_TEXT))
    parsed = documents.select(r.alias("r")).select("r.*")
    # Two keys can end up on one level; as the order of keys in a JSON object means nothing, the one that
    # sorts last counts.
    parsed = parsed.withColumn("_e", F.expr(
        f"transform(array_sort(map_entries(levels)), e -> struct({lv.known_name('e.key')} AS key, e.value AS value))"))
    levels = F.expr(
        "map_from_entries(filter(_e, (e, i) -> NOT exists(slice(_e, i + 2, size(_e)), later -> later.key = e.key)))")
    moment = lambda c: F.when(c != zero, c)
    groups = F.transform("top_errors", lambda g: F.struct(
        *[g[f].alias(f) for f in GROUP_FIELDS[:3]],
        moment(g["first_seen"]).alias("first_seen"), moment(g["last_seen"]).alias("last_seen"),
    ))
    return parsed.select(
        "source", "total_lines", levels.alias("levels"), F.coalesce(groups, F.array()).alias("top_errors"),
        moment(F.col("first_line")).alias("first_line"), moment(F.col("last_line")).alias("last_line"),
    )


def report_csv(reports: DataFrame) -> DataFrame:
    """``level, count, pct``: five rows per report, most severe first."""
    shares = level_shares(reports.select("source", "total_lines", "levels"))
    return shares.orderBy("source", "severity").select("level", "count", "pct")


def _group_rows(groups: Column, prefix: str) -> Column:
    """Aligned rows of error groups: number, signature, count, time span."""
    sign = F.array_max(F.transform(groups, lambda g: F.char_length(g["signature"]))) + 2
    times = F.array_max(F.transform(groups, lambda g: F.char_length(g["count"].cast("string")))) + 3
    number = F.char_length(F.size(groups).cast("string")) + len(prefix) + 3
    return F.transform(groups, lambda g, i: F.concat(
        F.rpad(F.concat(F.lit(prefix), (i + 1).cast("string"), F.lit(".")), number, F.lit(" ")),
        F.rpad(g["signature"], sign, F.lit(" ")),
        F.rpad(F.concat(g["count"].cast("string"), F.lit("x")), times, F.lit(" ")),
        F.lit("["), time_of_day(g["first_seen"]), F.lit(" - "), time_of_day(g["last_seen"]), F.lit("]"),
    ))


def report_text(reports: DataFrame) -> DataFrame:
    """``source, text``: header, time range, level table and numbered error groups."""
    first, last = F.col("first_line"), F.col("last_line")
    whole = F.greatest(F.col("total_lines"), F.lit(1))
    count_of = lambda n: F.coalesce(F.try_element_at("levels", F.lit(n)), F.lit(0))
    counts = [count_of(n).cast("string") for n in TEXT_ORDER]
    width = F.greatest(F.lit(5), *[F.char_length(c) for c in counts]) + 2
    cell = lambda text: F.rpad(text, width, F.lit(" "))
    span = F.concat(
        display_time(first), F.lit(" — "), display_time(last), F.lit(" ("),
        long_duration(F.unix_micros(last) - F.unix_micros(first)), F.lit(")"),
    )
    # Cells are padded to the longest of their column plus two.
    with_range = first.isNotNull()
    label = lambda text: F.lit(text.ljust(14))
    name = F.when(F.size("sources") > 1, F.concat(label("Files:"), F.array_join("sources", ", "))).otherwise(
        F.concat(label("File:"), F.col("source"))
    )
    lines = [
        name,
        F.concat(label("Total lines:"), F.col("total_lines").cast("string")),
        F.when(with_range, F.concat(label("Time range:"), span)),
        F.lit(""),
        F.concat(F.lit("Level  "), cell(F.lit("Count")), F.lit("%")),
        F.concat(F.lit("─────  "), cell(F.lit("─────")), F.lit("────")),
    ] + [
        F.concat(F.lit(n.ljust(7)), cell(c), percent(count_of(n), whole, 1), F.lit("%")) for n, c in zip(TEXT_ORDER, counts)
    ]
    head = F.array_compact(F.array(*lines))
    groups = F.when(
        F.size("top_errors") > 0,
        F.concat(F.array(F.lit(""), F.lit("Top errors:")), _group_rows(F.col("top_errors"), " ")),
    ).otherwise(F.array())
    return reports.select("source", F.array_join(F.concat(head, groups), "\n").alias("text"))


def top_text(reports: DataFrame) -> DataFrame:
    """``source, text``: the numbered error groups alone."""
    rows = F.array_join(_group_rows(F.col("top_errors"), ""), "\n")
    return reports.select(
        "source", F.when(F.size("top_errors") > 0, rows).otherwise("No errors found.").alias("text")
    )


def prompt_text(reports: DataFrame) -> DataFrame:
    """``source, prompt``: a report put into words for a summarizing model."""
    first, last = F.col("first_line"), F.col("last_line")
    span = F.concat(F.lit("Time range: "), display_time(first), F.lit(" — "), display_time(last))
    levels = [
        F.when(F.try_element_at("levels", F.lit(n)) > 0,
               F.concat(F.lit(f"  {n}: "), F.try_element_at("levels", F.lit(n)).cast("string")))
        for n in lv.BY_SEVERITY
    ]
    groups = F.transform("top_errors", lambda g, i: F.concat(
        (i + 1).cast("string"), F.lit(". ["), g["count"].cast("string"), F.lit("x] "), g["signature"],
        F.when(g["sample"] != "", F.concat(F.lit("\n   Sample: "), g["sample"])).otherwise(""),
    ))
    blocks = F.concat(
        F.array_compact(F.array(
            F.lit(PROMPT_TASK), F.lit(""),
            F.concat(F.lit("Log source: "), F.col("source")),
            F.concat(F.lit("Total lines analyzed: "), F.col("total_lines").cast("string")),
            F.when(first.isNotNull(), span), F.lit(""), F.lit("Level distribution:"), *levels,
        )),
        F.when(F.size("top_errors") > 0, F.concat(F.array(F.lit(""), F.lit("Top error patterns:")), groups))
        .otherwise(F.array()),
        F.array(F.lit("")),
    )
    return reports.select("source", F.array_join(blocks, "\n").alias("prompt"))
