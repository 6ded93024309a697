"""Events as NDJSON, CSV and text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.clock import display_time, rfc3339
from emberlog.sinks.reports import escape_html


def _stamp():
    return F.coalesce(rfc3339(F.col("ts")), F.lit(""))


def events_json(events: DataFrame) -> DataFrame:
    """``json``: timestamp ('' when there is none), level, source, message, line."""
    body = F.struct(
        _stamp().alias("timestamp"), F.col("level_name").alias("level"), "source", "message", "line",
    )
    return events.select(escape_html(F.to_json(body)).alias("json"))


def events_csv(events: DataFrame) -> DataFrame:
    """The columns of an events CSV file."""
    return events.select(_stamp().alias("timestamp"), F.col("level_name").alias("level"), "source", "message")


def event_text(events: DataFrame) -> DataFrame:
    """``text``: ``time LEVEL source:line message``."""
    return events.select(F.concat(
        F.coalesce(display_time(F.col("ts")), F.lit("")), F.lit(" "), F.col("level_name"), F.lit(" "), F.col("source"),
        F.lit(":"), F.col("line").cast("string"), F.lit(" "), F.col("message"),
    ).alias("text"))


def write_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    """CSV files with a header; quotes are doubled, spaces kept, only nulls and empty texts left blank."""
    rows.write.mode(mode).csv(
        path, header=True, escape='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_text(rows: DataFrame, path: str, mode: str = "error") -> None:
    """The single text column as text files."""
    rows.write.mode(mode).text(path)
