"""Lines of texts that are already in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_return(text: Column) -> Column:
    """One trailing carriage return taken off."""
    return F.when(F.endswith(text, F.lit("\r")), F.expr("substring(text, 1, char_length(text) - 1)")).otherwise(text)


def split_lines(texts: DataFrame, column: str = "text", raw: bool = False) -> DataFrame:
    """One row per line of a text, with ``line`` counted from 1; all other columns are kept.

    A last line without a newline counts, a newline at the end starts no further line, and a carriage return
    before a newline is dropped.  ``raw`` keeps returns and the empty piece after the last newline, the way
    a viewer numbers a file.
    """
    kept = [c for c in texts.columns if c != column]
    pieces = texts.select(*kept, F.split(column, "\n").alias("_p"))
    if not raw:
        last = F.size("_p")
        pieces = pieces.withColumn(
            "_p", F.when(F.element_at("_p", -1) == "", F.slice("_p", F.lit(1), last - 1)).otherwise(F.col("_p"))
        )
    rows = pieces.select(*kept, F.posexplode("_p").alias("_i", "text"))
    text = F.col("text") if raw else strip_return(F.col("text"))
    return rows.select(*kept, (F.col("_i") + 1).cast("bigint").alias("line"), text.alias("text"))
