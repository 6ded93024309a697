"""Timestamp formats found in log lines, as SQL text over columns given as SQL text.

``candidate`` cuts the first text that looks like a format out of a line ('' when there is none) and the
format's value function turns it into a timestamp (null when it is not a valid moment).  All values are
UTC; an hour or day out of range gives null.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# The month names and the candidate pattern of each format.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
MONTH_CHOICE = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
SPACE = r"[\t\n\f\r ]"
ISO = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
DATE_SPACE = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?"
SYSLOG = rf"(?=[JFMASOND])(?:{MONTH_CHOICE}){SPACE}+\d{{1,2}}{SPACE}+\d{{2}}:\d{{2}}:\d{{2}}"
APACHE = rf"\d{{2}}/(?:{MONTH_CHOICE})/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}}{SPACE}+\+\d{{4}}"
EPOCH = r"^\d{10}"

_DAY_MICROS = 24 * 3600 * 1_000_000


def micros_of(moment: datetime) -> int:
    """Microseconds since 1970; a datetime without a zone is UTC."""
    aware = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return (aware - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def now_sql(now: datetime | None) -> str:
    """The moment "now" as SQL text; None is the query's start."""
    return "current_timestamp()" if now is None else f"timestamp_micros({micros_of(now)}L)"


def now_column(now: datetime | Column | None) -> Column:
    return now if isinstance(now, Column) else F.expr(now_sql(now))


def candidate(raw: str, pattern: str) -> str:
    return f"regexp_extract({raw}, r'{pattern}', 0)"


def _moment(text: str) -> str:
    return f"try_cast(concat({text}, 'Z') AS timestamp)"


def _minus_minutes(ts: str, minutes: str) -> str:
    return f"timestamp_micros(unix_micros({ts}) - ({minutes}) * 60000000L)"


def _offset_minutes(hours: str, minutes: str) -> str:
    """Zone offset in minutes; null beyond 24 hours or 60 minutes."""
    h, m = f"try_cast({hours} AS int)", f"try_cast({minutes} AS int)"
    return f"CASE WHEN {h} <= 24 AND {m} <= 60 THEN {h} * 60 + {m} END"


def _micros(rest: str) -> str:
    """Fraction of a second, cut to the six digits a timestamp holds."""
    return rf"regexp_extract({rest}, r'^\.[0-9]{{1,6}}', 0)"


def iso_value(match: str) -> str:
    """ISO-8601; no zone is UTC, a zone without its colon is not accepted."""
    rest = f"substr({match}, 20)"
    base = _moment(f"substr({match}, 1, 19), {_micros(rest)}")
    colon_zone = rf"{match} RLIKE r'[+-][0-9]{{2}}:[0-9]{{2}}\z'"
    bare_zone = rf"{match} RLIKE r'T.*[+-][0-9]{{4}}\z'"
    offset = _offset_minutes(f"substr({match}, -5, 2)", f"substr({match}, -2, 2)")
    sign = f"CASE substr({match}, -6, 1) WHEN '-' THEN -1 ELSE 1 END"
    return (
        f"CASE WHEN {match} = '' OR {bare_zone} THEN NULL"
        f" WHEN {colon_zone} THEN {_minus_minutes(base, f'({sign}) * ({offset})')} ELSE {base} END"
    )


def date_space_value(match: str) -> str:
    """Date and time with one space between."""
    rest = f"substr({match}, 20)"
    return f"CASE WHEN {match} <> '' THEN {_moment(f'substr({match}, 1, 19), {_micros(rest)}')} END"


def _month(name: str) -> str:
    return f"lpad(cast((instr('{MONTHS}', {name}) + 2) DIV 3 AS string), 2, '0')"


def syslog_value(match: str, now: str) -> str:
    """Month, day and time without a year: this year, or last year when that is over a day ahead of now."""
    day = f"lpad(regexp_extract({match}, r'{SPACE}([0-9]{{1,2}}){SPACE}', 1), 2, '0')"
    clock = f"substr({match}, -8, 8)"
    date = f"'-', {_month(f'substr({match}, 1, 3)')}, '-', {day}, ' ', {clock}"

    def in_year(year: str, rest: str) -> str:
        return _moment(f"lpad(cast({year} AS string), 4, '0'), {rest}")

    here = in_year(f"year({now})", date)
    # 29 February has no counterpart a year earlier; it moves on to 1 March.
    last = f"year({now}) - 1"
    before = f"coalesce({in_year(last, date)}, {in_year(last, f"'-03-01 ', {clock}")})"
    return (
        f"CASE WHEN {match} = '' THEN NULL WHEN unix_micros({here}) > unix_micros({now}) + {_DAY_MICROS}L"
        f" THEN {before} ELSE {here} END"
    )


def apache_value(match: str) -> str:
    """Common log format; only spaces may stand before the (always positive) zone."""
    base = _moment(
        f"substr({match}, 8, 4), '-', {_month(f'substr({match}, 4, 3)')}, '-', substr({match}, 1, 2), ' ',"
        f" substr({match}, 13, 8)"
    )
    offset = _offset_minutes(f"substr({match}, -4, 2)", f"substr({match}, -2, 2)")
    return f"CASE WHEN {match} RLIKE r':[0-9]{{2}} +[+]' THEN {_minus_minutes(base, offset)} END"


def epoch_value(match: str) -> str:
    """Ten digits at the start of the line: seconds since 1970."""
    return f"CASE WHEN {match} <> '' THEN timestamp_seconds(try_cast({match} AS bigint)) END"


def formats(now: str) -> dict[str, tuple[str, Callable[[str], str]]]:
    """Formats in order of preference: name -> (pattern, value function)."""
    return {
        "iso": (ISO, iso_value),
        "date_space": (DATE_SPACE, date_space_value),
        "syslog": (SYSLOG, lambda match: syslog_value(match, now)),
        "apache": (APACHE, apache_value),
        "epoch": (EPOCH, epoch_value),
    }
