"""Predicates on events and reports."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions import levels as lv
from emberlog.functions.clock import parse_duration, parse_rfc3339
from emberlog.functions.patterns import found_in, to_java
from emberlog.functions.timestamps import now_column
from emberlog.operators import paging

_log = logging.getLogger(__name__)


def min_level(minimum: int) -> Column:
    return F.col("level") >= minimum if minimum > lv.DEBUG else F.lit(True)


def raw_matches(pattern: str) -> Column:
    """The pattern (RE2 syntax) is found anywhere in the whole line."""
    return found_in(F.col("raw"), pattern)


def since(moment: datetime | Column) -> Column:
    """Not before the moment; events without a timestamp pass."""
    return F.col("ts").isNull() | (F.col("ts") >= now_column(moment))


def until(moment: datetime | Column) -> Column:
    """Not after the moment; events without a timestamp pass."""
    return F.col("ts").isNull() | (F.col("ts") <= now_column(moment))


@dataclass(frozen=True)
class LogFilter:
    """All conditions an event must meet; None leaves a condition out."""

    level: int = lv.DEBUG
    pattern: str | None = None
    since: datetime | None = None
    until: datetime | None = None

    def __post_init__(self):
        if self.pattern is not None:
            to_java(self.pattern)

    @classmethod
    def from_options(
        cls, level: str = "", regex: str = "", since: str = "", until: str = "", now: datetime | None = None
    ) -> "LogFilter":
        """From texts: level name, pattern, duration before now, RFC 3339 moment.

        A level, duration or moment that cannot be read is left out with a warning; a bad pattern raises
        ``ValueError``.
        """
        values = {"level": lv.rank(level), "since": parse_duration(since), "until": parse_rfc3339(until)}
        for name, text in (("level", level), ("since", since), ("until", until)):
            if text and values[name] is None:
                _log.warning("ignoring %s=%r", name, text)
        start = None
        if values["since"] is not None:
            start = (now or datetime.now(timezone.utc)) - values["since"]
        return cls(
            level=lv.DEBUG if values["level"] is None else values["level"],
            pattern=regex or None, since=start, until=values["until"],
        )

    def at_least(self, level: int) -> "LogFilter":
        return replace(self, level=max(self.level, level))

    def condition(self) -> Column:
        parts = [min_level(self.level)] if self.level > lv.DEBUG else []
        if self.pattern is not None:
            parts.append(raw_matches(self.pattern))
        if self.since is not None:
            parts.append(since(self.since))
        if self.until is not None:
            parts.append(until(self.until))
        out = F.lit(True)
        for part in parts:
            out = out & part
        return out

    def apply(self, events: DataFrame) -> DataFrame:
        return events.filter(self.condition())


def level_is(events: DataFrame, name: str) -> DataFrame:
    return events.filter(F.col("level_name") == name)


def search_messages(
    events: DataFrame, text: str, page_only: bool = False, offset: int = 0, limit: int = paging.PAGE
) -> DataFrame:
    """Events whose message holds the text, any case.

    ``page_only`` looks at the given page alone instead of at all events.
    """
    if page_only:
        events = paging.page(events, offset, limit)
    return events.filter(F.lower("message").contains(F.lower(F.lit(text))))


def search_reports(reports: DataFrame, text: str = "", sort: str = "date") -> DataFrame:
    """Reports whose file name or status holds the text, by name or newest first."""
    if text:
        q = F.lower(F.lit(text))
        reports = reports.filter(
            F.coalesce(F.lower("file_name").contains(q), F.lit(False)) | F.coalesce(F.lower("status").contains(q), F.lit(False))
        )
    return reports.orderBy(F.col("file_name").asc() if sort == "name" else F.col("created_at").desc())
