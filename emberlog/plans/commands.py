"""The user-level commands: scan, errors, top, grep and the analysis request."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import levels as lv
from emberlog.operators import aggregate, paging
from emberlog.operators.filters import LogFilter
from emberlog.operators.fold import fold as fold_lines
from emberlog.operators.parse import as_lines, parse_events
from emberlog.session import scratch_dir
from emberlog.sources.files import LINES_SCHEMA, resolve
from emberlog.sources.waves import waves


def events_of(
    lines: DataFrame, where: LogFilter = LogFilter(), fold: bool = False, now: datetime | None = None,
    compat: bool = True, cross_source: bool = False,
) -> DataFrame:
    """Lines folded if asked for, parsed and filtered."""
    if fold:
        lines = fold_lines(lines, cross_source=cross_source)
    return where.apply(parse_events(lines, now=now, compat=compat))


def scan(
    lines: DataFrame, where: LogFilter = LogFilter(), k: int = aggregate.TOP, mode: str = aggregate.EXACT,
    by: str | None = None, sources: list[str] | None = None, **options,
) -> DataFrame:
    """Report over all levels."""
    label = sources[0] if sources else "stdin"
    events = events_of(lines, where, **options)
    if options.get("fold"):
        # Folding again for a few sample messages costs more than carrying the messages along.
        return aggregate.report_of_groups(aggregate.report_groups(events, by), k, mode, by, label, sources or [label])
    return aggregate.report(events, k, mode, by, label, sources or [label])


def errors(lines: DataFrame, where: LogFilter = LogFilter(), n: int = paging.FIRST, **options) -> DataFrame:
    """First events of level ERROR and up."""
    return paging.first_n(events_of(lines, where.at_least(lv.ERROR), **options), n)


def top(lines: DataFrame, where: LogFilter = LogFilter(), **options) -> DataFrame:
    """Report over errors alone."""
    return scan(lines, where.at_least(lv.ERROR), **options)


def grep(
    lines: DataFrame, pattern: str, where: LogFilter = LogFilter(), n: int = paging.FIRST, **options
) -> DataFrame:
    """First events whose line matches the pattern, which takes the place of the filter's own."""
    only = LogFilter(where.level, pattern, where.since, where.until)
    return paging.first_n(events_of(lines, only, **options), n)


def first_of_files(
    spark: SparkSession, paths: list[str], where: LogFilter = LogFilter(), n: int = paging.FIRST,
    now: datetime | None = None, compat: bool = True, **options,
) -> tuple[DataFrame, int]:
    """The first ``n`` matching events of files, and the bytes read to find them.

    Files are read in order, in parts that grow by four, until enough events match; what lies behind is never
    opened.  ``n`` must be positive.  The events found in each part are written to the scratch folder, not collected.
    ``options`` are those of ``waves``.
    """
    if n <= 0:
        raise ValueError("to take all events, read the files whole")
    out, found, read = scratch_dir(spark), 0, 0
    schema = events_of(spark.createDataFrame([], LINES_SCHEMA), where, now=now, compat=compat).schema
    parts = []
    for lines, size in waves(spark, resolve(spark, paths), **options):
        parts.append(f"{out}/{len(parts)}")
        paging.first_n(events_of(lines, where, now=now, compat=compat), n - found).write.parquet(parts[-1])
        found += spark.read.schema(schema).parquet(parts[-1]).count()
        read += size
        if found >= n:
            break
    events = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    return paging.first_n(events, n), read


def page(
    lines: DataFrame, where: LogFilter = LogFilter(), offset: int | None = 0, limit: int | None = paging.PAGE,
    now: datetime | None = None, compat: bool = True,
) -> DataFrame:
    """A page of matching events in arrival order, with the number of all of them in ``total``.

    Where nothing parsed decides what matches, lines are counted and paged as they are and only the page is parsed.
    """
    lines = as_lines(lines)
    if where.level > lv.DEBUG or where.since is not None or where.until is not None:
        return paging.page_with_total(where.apply(parse_events(lines, now=now, compat=compat)), offset, limit)
    if where.pattern is not None:
        lines = where.apply(lines.withColumn("raw", F.col("text"))).drop("raw")
    rows, total = paging.page_and_count(lines, offset, limit)
    return parse_events(rows, now=now, compat=compat).withColumn("total", total.scalar())


@dataclass(frozen=True)
class AnalyzeOptions:
    """An analysis request with every option as text, as a service receives it."""

    command: str = "scan"
    level: str = ""
    regex: str = ""
    limit: int = 0
    since: str = ""
    until: str = ""
    fold: bool = False

    def __post_init__(self):
        if self.command not in ("scan", "errors", "top", "grep"):
            raise ValueError(f"unknown command: {self.command}")

    @property
    def k(self) -> int:
        return paging.clamp_limit(self.limit)


def analyze(lines: DataFrame, options: AnalyzeOptions, name: str, now: datetime | None = None) -> DataFrame:
    """Report for scan and top; for errors and grep every matching event, in arrival order."""
    where = LogFilter.from_options(options.level, options.regex, options.since, options.until, now)
    if options.command in ("errors", "top"):
        where = where.at_least(lv.ERROR)
    if options.command in ("scan", "top"):
        return scan(lines, where, k=options.k, sources=[name], fold=options.fold, now=now)
    return paging.first_n(events_of(lines, where, options.fold, now), 0)
