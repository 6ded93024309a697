"""Severity levels: names, ranks and keyword detection, over columns given as SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEBUG, INFO, WARN, ERROR, FATAL = -1, 0, 1, 2, 3

# Rank of each level name.
RANKS = {"DEBUG": DEBUG, "INFO": INFO, "WARN": WARN, "ERROR": ERROR, "FATAL": FATAL}

# Keyword -> rank, in the order keywords are tried.
KEYWORDS = {
    "FATAL": FATAL,
    "CRITICAL": FATAL,
    "PANIC": FATAL,
    "ERROR": ERROR,
    "WARN": WARN,
    "WARNING": WARN,
    "INFO": INFO,
    "DEBUG": DEBUG,
    "TRACE": DEBUG,
}

# Levels from most to least severe, the order of most reports.
BY_SEVERITY = ("FATAL", "ERROR", "WARN", "INFO", "DEBUG")

_LOWER = "abcdefghijklmnopqrstuvwxyz"


def rank(name: str) -> int | None:
    """Rank of a level alias, any case; None when it is not one."""
    return KEYWORDS.get(name.upper())


def parse_level(name: str) -> Column:
    """``struct(level, found)`` for a level alias, any case; unknown names are INFO, not found."""
    names = ", ".join(f"'{k}'" for k in KEYWORDS)
    return F.expr(f"named_struct('level', {rank_of(f'upper({name})')}, 'found', upper({name}) IN ({names}))")


def known_name(name: str) -> str:
    """SQL text: the canonical name for a level alias, INFO for anything else."""
    return name_of(rank_of(f"upper({name})"))


def name_of(level: str) -> str:
    """SQL text: the name of a rank, UNKNOWN for anything else."""
    return f"CASE {level} " + " ".join(f"WHEN {r} THEN '{n}'" for n, r in RANKS.items()) + " ELSE 'UNKNOWN' END"


def level_name(level: str) -> Column:
    return F.expr(name_of(level))


def fold_case(text: str) -> str:
    """SQL text: upper case that never moves a character position.

    ``upper`` turns some letters into two (sharp s), which would shift every position after it.  When
    the length changes only ASCII letters are raised, the only ones a keyword can contain.
    """
    return (
        f"CASE WHEN octet_length({text}) = char_length({text}) OR char_length(upper({text})) = char_length({text})"
        f" THEN upper({text}) ELSE translate({text}, '{_LOWER}', '{_LOWER.upper()}') END"
    )


def find_keyword(folded: str) -> str:
    """SQL text: the level keyword in case-folded text, null if there is none.

    Keywords are tried from most severe down.  Only the first occurrence of each counts, and it must
    not touch an ASCII letter on either side.  Most keywords are absent, which ``contains`` finds out
    several times faster than a position search.
    """
    out = "CASE"
    for keyword in KEYWORDS:
        around = f"substr({folded}, instr({folded}, '{keyword}') - 1, {len(keyword) + 2})"
        out += (
            f" WHEN contains({folded}, '{keyword}') AND NOT ({around} RLIKE '[A-Z]{keyword}|{keyword}[A-Z]')"
            f" THEN '{keyword}'"
        )
    return out + " END"


def rank_of(keyword: str) -> str:
    """SQL text: the rank of a keyword, INFO for null."""
    return f"CASE {keyword} " + " ".join(f"WHEN '{k}' THEN {r}Y" for k, r in KEYWORDS.items()) + f" ELSE {INFO}Y END"


def detect_level(raw: str) -> Column:
    """``struct(level, found)`` of the keyword anywhere in a whole line; INFO when there is none."""
    hit = find_keyword(fold_case(raw))
    return F.expr(f"named_struct('level', {rank_of(hit)}, 'found', ({hit}) IS NOT NULL)")
