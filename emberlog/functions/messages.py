"""Message text of a log line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space trimmed from a message, and the punctuation dropped in front of it.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LEADING_PUNCTUATION = ":-[]() \t"


def trim_space(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))


def tail(rest: str, cut: str) -> str:
    """SQL text: ``rest`` from 0-based ``cut`` on; all of it when ``cut`` is null or leaves nothing."""
    return f"CASE WHEN {cut} > 0 AND {cut} < char_length({rest}) THEN substr({rest}, {cut} + 1) ELSE {rest} END"


def message(raw: str, tail: str) -> str:
    """SQL text: the tail of a line without white space and leading punctuation; the line if that leaves nothing."""
    space = f"'{WHITE_SPACE}'"
    bare = f"trim(LEADING {space} FROM trim(LEADING '{LEADING_PUNCTUATION}' FROM trim(BOTH {space} FROM {tail})))"
    return f"coalesce(nullif({bare}, ''), trim(BOTH {space} FROM {raw}))"
