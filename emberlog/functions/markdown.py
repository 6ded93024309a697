"""Markdown marks removed from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (pattern, replacement) in the order they apply.  "." stops at a newline only; "^" holds at
# the start of every line and "$" at the end of every line, the last, empty one included.
RULES = [
    (r"(?d)\*\*(.+?)\*\*", "$1"),
    (r"(?d)__(.+?)__", "$1"),
    (r"(?d)\*(.+?)\*", "$1"),
    (r"(?d)_(.+?)_", "$1"),
    (r"(?d)`(.+?)`", "$1"),
    (r"(?<![^\n])#{1,6}[\t\n\f\r ]+", ""),
    (r"(?<![^\n])-{3,}(?![^\n])", ""),
]


def strip_markdown(text: Column) -> Column:
    """Bold, italic and code marks, heading marks and rules taken off."""
    for pattern, replacement in RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return text
