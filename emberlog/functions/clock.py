"""Durations and times as text."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nanoseconds per unit of a duration text.
_UNITS = {
    "ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9,
}
_PART = r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)"
_RFC3339 = re.compile(
    r"(\d{4})-(\d{2})-(\d{2})T(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?(?:Z|([+-])(\d{2}):(\d{2}))"
)

ZERO_MOMENT_TEXT = "0001-01-01T00:00:00Z"


def parse_duration(text: str) -> timedelta | None:
    """``1h30m``, ``-1.5s``, ``300ms``, ``0``; None when the text is no duration."""
    sign, body = (text[0], text[1:]) if text[:1] in ("+", "-") else ("+", text)
    if body == "0":
        return timedelta(0)
    if not re.fullmatch(f"(?:{_PART})+", body):
        return None
    nanos = int(sum(Fraction("0" + n if n.startswith(".") else n.rstrip(".")) * _UNITS[u]
                    for n, u in re.findall(_PART, body)))
    if nanos >= 1 << 63:
        return None
    return timedelta(microseconds=nanos // 1000) * (-1 if sign == "-" else 1)


def parse_rfc3339(text: str) -> datetime | None:
    """An RFC 3339 moment in UTC; None when the text is not one."""
    m = _RFC3339.fullmatch(text)
    if not m:
        return None
    try:
        moment = datetime(*map(int, m.group(1, 2, 3, 4, 5, 6)), tzinfo=timezone.utc)
    except ValueError:
        return None
    moment += timedelta(microseconds=int((m[7] or "0").ljust(6, "0")[:6]))
    if m[8]:
        hours, minutes = int(m[9]), int(m[10])
        if hours > 24 or minutes > 60:
            return None
        moment += timedelta(hours=hours, minutes=minutes) * (1 if m[8] == "-" else -1)
    return moment


def rfc3339(ts: Column) -> Column:
    """``2026-07-08T10:12:33.5Z``: trailing zeros of the fraction, and an empty fraction, left out."""
    fraction = F.rtrim(F.date_format(ts, ".SSSSSS"), F.lit("0"))
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == ".", "").otherwise(fraction), F.lit("Z")
    )


def rfc3339_or_zero(ts: Column) -> Column:
    """As ``rfc3339``, the zero moment for null."""
    return F.coalesce(rfc3339(ts), F.lit(ZERO_MOMENT_TEXT))


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def time_of_day(ts: Column) -> Column:
    """``10:12:33``; null is midnight."""
    return F.coalesce(F.date_format(ts, "HH:mm:ss"), F.lit("00:00:00"))


def _text(n: Column) -> Column:
    return n.cast("string")


def short_duration(seconds: Column) -> Column:
    """Seconds as ``42s``, ``3m 5s`` or ``2h 7m``."""
    s = seconds.cast("bigint")
    return (
        F.when(s < 60, F.concat(_text(s), F.lit("s")))
        .when(s < 3600, F.concat(_text(F.floor(s / 60)), F.lit("m "), _text(s % 60), F.lit("s")))
        .otherwise(F.concat(_text(F.floor(s / 3600)), F.lit("h "), _text(F.floor((s % 3600) / 60)), F.lit("m")))
    )


def long_duration(micros: Column) -> Column:
    """Microseconds rounded to the second, as ``14s``, ``1m0s`` or ``4h0m0s``."""
    s = F.floor((micros + 500_000) / 1_000_000)
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    minutes = F.concat(_text(m), F.lit("m"))
    return F.concat(
        F.when(h > 0, F.concat(_text(h), F.lit("h"), minutes)).when(m > 0, minutes).otherwise(""),
        _text(s % 60), F.lit("s"),
    )


def percent(part: Column, whole: Column, digits: int) -> Column:
    """``part / whole * 100`` with a fixed number of decimals, as C's printf rounds it.

    Java's formatter rounds the shortest decimal text of a double, C the double itself; the two differ
    next to a tie.  The double is therefore compared with the midpoint exactly: it is split in two so that
    both products are free of rounding.
    """
    scale = 10**digits
    value = part.cast("double") / whole.cast("double") * 100.0
    high = F.floor(value * float(1 << 20)) / float(1 << 20)
    low = value - high
    near = F.floor(value * float(scale))
    past_middle = (high * (2.0 * scale) - (near * 2 + 1).cast("double")) + low * (2.0 * scale)
    up = (past_middle > 0) | ((past_middle == 0) & (near % 2 == 1))
    units = near + F.when(up, 1).otherwise(0)
    return F.concat(
        _text(F.floor(units / scale)), F.lit("."), F.lpad(_text(units % scale), digits, "0")
    )
