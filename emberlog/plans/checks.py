"""Registered queries over the test tables, each with the DuckDB statement it must agree with.

Timestamps leave as text and nested values as JSON, so that both engines print them alike.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import levels as lv
from emberlog.functions import timestamps as tm
from emberlog.functions.clients import client_key
from emberlog.functions.clock import rfc3339, short_duration
from emberlog.functions.markdown import strip_markdown
from emberlog.functions.normalize import RULES, rewrite, with_signature
from emberlog.operators import admission as adm
from emberlog.operators import aggregate as agg
from emberlog.operators import filters as flt
from emberlog.operators.fold import fold
from emberlog.operators.paging import first_n, page
from emberlog.operators.parse import parse_events
from emberlog.plans import commands
from emberlog.plans import oracle as o
from emberlog.session import scratch_dir
from emberlog.sinks import events as ev_out
from emberlog.sinks import reports as rep_out
from emberlog.sinks.logs import write_logs
from emberlog.sources.files import read_lines
from emberlog.sources.lines import split_lines
from emberlog.sources.many import read_many
from emberlog.sources.tables import SOURCES, log_lines, log_lines_sql, log_lines_stream, table, table_stream
from emberlog.sources.tail import sized_for, tail_lines
from emberlog.streaming.admission import admission_stream
from emberlog.streaming.fold import fold_stream
from emberlog.streaming.watch import watch_events, watch_report

NOW = datetime(2024, 12, 31)
SINCE, UNTIL = datetime(2024, 1, 10), datetime(2024, 1, 20)
SINCE_SQL = "(ts IS NULL OR ts >= TIMESTAMP '2024-01-10 00:00:00')"
UNTIL_SQL = "(ts IS NULL OR ts <= TIMESTAMP '2024-01-20 00:00:00')"
PATTERN = r"(?i)timeout|\brefused\b"
PATTERN_SQL = f"regexp_matches(raw, {o.q(PATTERN)})"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def ts_text(col: str | Column, name: str | None = None) -> Column:
    out = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return out.alias(name or col)


def events(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return parse_events(log_lines(spark, sf_dir), now=NOW, **options)


def _big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def event_rows(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(ts_text("ts"), *_big("level"), "level_name", "source", "message", "raw", *_big("line"), *extra)


EVENT_ROWS = f"{o.ts_text('ts')} AS ts, cast(level AS bigint) AS level, level_name, source, message, raw, line"

# --- sources ---------------------------------------------------------------------------------------------

# Document texts with carriage returns, and for every other one a newline at the end.
_RETURNS = (
    "concat(replace(text, '. ', concat('.', {chr13}, {chr10})), CASE WHEN doc_id % 2 = 0 THEN {chr10} ELSE '' END)"
)
_PIECES = "SELECT doc_id, unnest(string_split(t, chr(10))) AS text, generate_subscripts(string_split(t, chr(10)), 1)" \
          " AS line, len(string_split(t, chr(10))) AS n FROM (SELECT doc_id, {t} AS t FROM documents)"


@query("split_lines", f"""SELECT doc_id, line, CASE WHEN right(text, 1) = chr(13) THEN left(text, -1) ELSE text END AS text
FROM ({_PIECES.format(t=_RETURNS.format(chr13='chr(13)', chr10='chr(10)'))}) WHERE NOT (line = n AND text = '')""")
def _split_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.expr(_RETURNS.format(chr13="chr(13)", chr10="chr(10)"))
    return split_lines(docs.select("doc_id", text.alias("text")))


@query("raw_view", f"SELECT doc_id, line, text FROM ({_PIECES.format(t='text')})")
def _raw_view(spark, sf_dir):
    return split_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), raw=True)


def _as_files(lines, path: str, **options) -> None:
    """One text file per source, its lines in order."""
    ordered = lines.select("source", "line", "text").repartition("source").sortWithinPartitions("source", "line")
    ordered.select("source", "text").write.partitionBy("source").text(path, **options)


def _source_of(path):
    return F.regexp_extract(path, "source=([^/]+)/", 1).alias("source")


@query("line_numbers", f"SELECT source, line, text FROM ({log_lines_sql()})")
def _line_numbers(spark, sf_dir):
    """Lines written as one text file per source, and read back with their numbers."""
    path = scratch_dir(spark)
    _as_files(log_lines(spark, sf_dir), path)
    return read_lines(spark, [f"{path}/source=*/*.txt"]).select(_source_of("source"), "line", "text")


@query("read_lines", f"""SELECT source_ord, source, line, text FROM ({log_lines_sql()})
UNION ALL SELECT {SOURCES}, source, line, text FROM ({log_lines_sql()}) WHERE source_ord = 2""")
def _read_lines(spark, sf_dir):
    """Plain and compressed files by pattern, in the order of their names; a path named again is read again."""
    path = scratch_dir(spark)
    lines = log_lines(spark, sf_dir)
    _as_files(lines.filter("source_ord % 2 = 0"), f"{path}/plain")
    _as_files(lines.filter("source_ord % 2 = 1"), f"{path}/packed", compression="gzip")
    some = [f"{path}/{'packed' if i % 2 else 'plain'}/source=app-{i}.log/part-*" for i in range(SOURCES)]
    back = read_lines(spark, [*some, f"{path}/nothing/*.log", some[2]])
    return back.select("source_ord", _source_of("source"), "line", "text")


@query("long_lines", f"SELECT source, line, strlen(text) > 60 AS too_long, text FROM ({log_lines_sql()})")
def _long_lines(spark, sf_dir):
    """Long lines are kept, and told apart by a column."""
    path = scratch_dir(spark)
    _as_files(log_lines(spark, sf_dir), path)
    back = read_lines(spark, [f"{path}/source=*/*.txt"], max_line_bytes=60)
    return back.select(_source_of("source"), "line", "too_long", "text")


@query("raw_view_files", f"SELECT source, line, text FROM ({log_lines_sql()}) ORDER BY source_ord, line LIMIT 40 OFFSET 325")
def _raw_view_files(spark, sf_dir):
    """A window of the numbered lines of compressed files."""
    path = scratch_dir(spark)
    _as_files(log_lines(spark, sf_dir), path, compression="gzip")
    return page(read_lines(spark, [f"{path}/source=*/*.gz"]), 325, 40).select(_source_of("source"), "line", "text")


# --- timestamps and levels -------------------------------------------------------------------------------

_MON = f"substr('{tm.MONTHS}', cast(event_id % 12 * 3 + 1 AS int), 3)"
_CLOCK = "concat(lpad(cast(event_id % 25 AS string), 2, '0'), ':', lpad(cast(event_id % 61 AS string), 2, '0'), ':'," \
         " lpad(cast(user_id % 61 AS string), 2, '0'))"
_DATE = "concat(cast(2020 + event_id % 8 AS string), '-', lpad(cast(event_id % 14 AS string), 2, '0'), '-'," \
        " lpad(cast(user_id % 33 AS string), 2, '0'))"
_FRACTION = "CASE cast(user_id % 4 AS int) WHEN 0 THEN '' WHEN 1 THEN '.5' WHEN 2 THEN '.123456' ELSE '.123456789' END"
_ZONE = "CASE cast(event_id % 6 AS int) WHEN 0 THEN '' WHEN 1 THEN 'Z' WHEN 2 THEN '+02:00' WHEN 3 THEN '-05:30'" \
        " WHEN 4 THEN '+0530' ELSE '+24:60' END"
_PLUS = "CASE cast(event_id % 5 AS int) WHEN 0 THEN ' +0000' WHEN 1 THEN ' +0530' WHEN 2 THEN ' -0700'" \
        " WHEN 3 THEN '   +0200' ELSE ' +2561' END"

# One timestamp per line, valid and invalid ones mixed: format -> line text, the same in both engines.
STAMPED = {
    "iso": f"concat('at ', {_DATE}, 'T', {_CLOCK}, {_FRACTION}, {_ZONE}, ' ERROR x')",
    "date_space": f"concat('[', {_DATE}, ' ', {_CLOCK}, {_FRACTION}, '] WARN x')",
    "syslog": f"concat({_MON}, '  ', cast(user_id % 33 AS string), ' ', {_CLOCK}, ' host x')",
    "apache": f"concat('10.0.0.1 - - [', lpad(cast(user_id % 33 AS string), 2, '0'), '/', {_MON}, '/2023:', {_CLOCK},"
              f" {_PLUS}, '] x')",
    "epoch": "concat(CASE cast(event_id % 3 AS int) WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE '9' END,"
             " cast(1700000000 + event_id * 977 AS string), CASE cast(user_id % 2 AS int) WHEN 0 THEN '' ELSE '123' END, ' x')",
}
_MIDYEAR = datetime(2024, 7, 1)
_VALUES = {
    "iso": (o.ISO, o.iso_sql),
    "date_space": (o.DATE_SPACE, o.date_space_sql),
    "syslog": (o.SYSLOG, lambda m: o.syslog_sql(m, str(_MIDYEAR))),
    "apache": (o.APACHE, o.apache_sql),
    "epoch": (o.EPOCH, o.epoch_sql),
}


def _stamped(spark, sf_dir, fmt):
    return table(spark, sf_dir, "events").select("event_id", F.expr(STAMPED[fmt]).alias("text"))


def _register_formats():
    for fmt, (pattern, value_sql) in _VALUES.items():
        def run(spark, sf_dir, fmt=fmt):
            pattern, value = tm.formats(tm.now_sql(_MIDYEAR))[fmt]
            found = _stamped(spark, sf_dir, fmt).selectExpr("*", f"{tm.candidate('text', pattern)} AS match")
            return found.select("event_id", "text", "match", ts_text(F.expr(value("match")), "ts"))

        sql = (
            f"SELECT event_id, text, match, {o.ts_text(value_sql('match'))} AS ts FROM (SELECT *,"
            f" regexp_extract(text, {o.q(pattern)}) AS match FROM (SELECT event_id, {STAMPED[fmt]} AS text FROM events))"
        )
        query(f"ts_{fmt}", sql)(run)


_register_formats()

# Two formats on one line, the first often invalid.
_MIXED = f"concat({STAMPED['date_space']}, ' | ', CASE cast(event_id % 4 AS int) WHEN 0 THEN {STAMPED['iso']}" \
         f" WHEN 1 THEN {STAMPED['syslog']} WHEN 2 THEN {STAMPED['apache']} ELSE '' END)"
_MIXED_LINES = f"SELECT 'a' AS source, 0 AS source_ord, event_id AS line, {_MIXED} AS text FROM events"


@query("ts_precedence", f"{o.events_cte(_MIXED_LINES)} SELECT line, raw, ts_format, {o.ts_text('ts')} AS ts, message FROM ev")
def _ts_precedence(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("line"), F.expr(_MIXED).alias("text"))
    return parse_events(lines, now=NOW, keep_format=True).select("line", "raw", "ts_format", ts_text("ts"), "message")


@query("level_detect", f"""SELECT line, source, cast(coalesce({o.level_sql('up', 'level')}, 0) AS bigint) AS level,
  cast({o.level_sql('up', 'pos')} AS bigint) AS pos FROM ({o.events_cte()} SELECT line, source, upper(message) AS up FROM ev)""")
def _level_detect(spark, sf_dir):
    raised = events(spark, sf_dir).selectExpr("line", "source", f"{lv.fold_case('message')} AS up")
    return raised.selectExpr("line", "source", "up", f"{lv.find_keyword('up')} AS k").selectExpr(
        "line", "source", f"cast({lv.rank_of('k')} AS bigint) AS level", "cast(instr(up, k) AS bigint) AS pos")


@query("level_detect_raw", f"""SELECT source, line, cast(coalesce({o.level_sql('up', 'level')}, 0) AS bigint) AS level,
  {o.level_sql('up', 'level')} IS NOT NULL AS found FROM (SELECT source, line, upper(text) AS up FROM ({log_lines_sql()}))""")
def _level_detect_raw(spark, sf_dir):
    return log_lines(spark, sf_dir).select("source", "line", lv.detect_level("text").alias("d")).select(
        "source", "line", F.col("d.level").cast("bigint").alias("level"), "d.found")


_ALIAS = """CASE cast(event_id % 12 AS int) WHEN 0 THEN 'fatal' WHEN 1 THEN 'Critical' WHEN 2 THEN 'PANIC' WHEN 3 THEN event_type
  WHEN 4 THEN 'Warn' WHEN 5 THEN 'WARNING' WHEN 6 THEN 'info' WHEN 7 THEN 'Debug' WHEN 8 THEN 'trace' WHEN 9 THEN ''
  WHEN 10 THEN ' ERROR' ELSE 'UNKNOWN' END"""
# Level names and their aliases.
_ALIAS_CASE = "CASE upper(name) WHEN 'FATAL' THEN 3 WHEN 'CRITICAL' THEN 3 WHEN 'PANIC' THEN 3 WHEN 'ERROR' THEN 2" \
              " WHEN 'WARN' THEN 1 WHEN 'WARNING' THEN 1 WHEN 'INFO' THEN 0 WHEN 'DEBUG' THEN -1 WHEN 'TRACE' THEN -1 END"


@query("level_parse", f"""SELECT event_id, name, cast(coalesce({_ALIAS_CASE}, 0) AS bigint) AS level, {_ALIAS_CASE} IS NOT NULL
  AS found FROM (SELECT event_id, {_ALIAS} AS name FROM events)""")
def _level_parse(spark, sf_dir):
    named = table(spark, sf_dir, "events").select("event_id", F.expr(_ALIAS).alias("name"))
    return named.withColumn("d", lv.parse_level("name")).select(
        "event_id", "name", F.col("d.level").cast("bigint").alias("level"), "d.found")


@query("level_name", f"SELECT event_id, {o.level_name_sql('(event_id % 7 - 2)')} AS level_name FROM events")
def _level_name(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", lv.level_name("(event_id % 7 - 2)").alias("level_name"))


@query("message_extract", f"{o.events_cte(compat=False)} SELECT source, line, raw, message FROM ev")
def _message_extract(spark, sf_dir):
    return events(spark, sf_dir, compat=False).select("source", "line", "raw", "message")


@query("parse_events", f"{o.events_cte()} SELECT {EVENT_ROWS}, ts_format FROM ev")
def _parse_events(spark, sf_dir):
    return event_rows(events(spark, sf_dir, keep_format=True), "ts_format")


_DOC_LINES = f"SELECT concat('doc-', doc_id) AS source, 0 AS source_ord, line, text FROM ({_PIECES.format(t='text')})"


def _doc_lines(spark, sf_dir):
    lines = split_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), raw=True)
    return lines.select(
        F.concat(F.lit("doc-"), "doc_id").alias("source"), F.lit(0).alias("source_ord"), F.col("line"), "text",
    )


@query("parse_documents", f"{o.events_cte(_DOC_LINES)} SELECT source, line, level_name, message FROM ev")
def _parse_documents(spark, sf_dir):
    return parse_events(_doc_lines(spark, sf_dir), now=NOW).select("source", "line", "level_name", "message")


@query("duration_text", """SELECT event_id, CASE WHEN s < 60 THEN concat(s, 's') WHEN s < 3600
  THEN concat(s // 60, 'm ', s % 60, 's') ELSE concat(s // 3600, 'h ', s % 3600 // 60, 'm') END AS duration
FROM (SELECT event_id, event_id * 37 % 20000 AS s FROM events)""")
def _duration_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", short_duration(F.col("event_id") * 37 % 20000).alias("duration"))


# --- normalizer and text ---------------------------------------------------------------------------------

# Volatile parts next to the text of a line, with boundaries of every kind around them.
_VOLATILE = """concat(text, ' ', CASE cast(line % 10 AS int)
  WHEN 0 THEN concat('fe80:0:0:0:a:b:c:', cast(line % 997 AS string)) WHEN 1 THEN concat('x::1 and ::1 at ', cast(line AS string))
  WHEN 2 THEN concat('span=', lpad(cast(line AS string), 9, 'z'), ' trace-abc') WHEN 3 THEN concat('0x', cast(line AS string), 'g 0xff')
  WHEN 4 THEN concat('/var/log/a.', cast(line AS string), ':12 and/or') WHEN 5 THEN concat(lpad(cast(line AS string), 64, 'deadbeef'), 'é')
  WHEN 6 THEN concat('é', cast(line AS string), ' ', cast(line AS string), '_ 1.5') WHEN 7 THEN concat('10.0.0.', cast(line % 300 AS string), '.7')
  WHEN 8 THEN concat('550e8400-e29b-41d4-a716-', lpad(cast(line AS string), 12, '0')) ELSE 'request_12345678 30s' END)"""


def _volatile(spark, sf_dir):
    both = log_lines(spark, sf_dir).select("source", "line", "text").unionByName(
        _doc_lines(spark, sf_dir).select("source", "line", "text"))
    return both.select("source", "line", F.expr(_VOLATILE).alias("text"))


_VOLATILE_SQL = f"SELECT source, line, {_VOLATILE} AS text FROM (SELECT source, line, text FROM ({log_lines_sql()})" \
                f" UNION ALL SELECT source, line, text FROM ({_DOC_LINES}))"


def _register_rules():
    for rule in RULES:
        def run(spark, sf_dir, rule=rule):
            return _volatile(spark, sf_dir).selectExpr("source", "line", f"{rewrite('text', rule)} AS text")

        query(f"norm_{rule}", f"SELECT source, line, {o.normalize_sql('text', [rule])} AS text FROM ({_VOLATILE_SQL})")(run)


_register_rules()


@query("normalize", f"SELECT source, line, {o.normalize_sql('text')} AS signature FROM ({_VOLATILE_SQL})")
def _normalize(spark, sf_dir):
    return with_signature(_volatile(spark, sf_dir), "text").drop("text")


# Marks put into document text, at line starts and inside words.
_MARKED = "concat({h}, replace(replace(replace(text, ' de ', ' **de** '), ' the ', ' _the_ '), '. ', {nl}), {nl}, '---', {nl}, '`x` __y__ *z*')"


def _marked(nl: str) -> str:
    return _MARKED.format(nl=nl, h=f"concat('## Title', {nl}, '---', {nl})")


@query("strip_markdown", f"SELECT doc_id, {o.markdown_sql(_marked('chr(10)'))} AS text FROM documents")
def _strip_markdown(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", strip_markdown(F.expr(_marked("chr(10)"))).alias("text"))


@query("strip_markdown_conversations", f"SELECT conv_id, turn, {o.markdown_sql('text')} AS text FROM conversations")
def _strip_markdown_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", strip_markdown(F.col("text")).alias("text"))


# --- fold ------------------------------------------------------------------------------------------------

# Three lines in four continue the one before; source 1 starts with a continuation.
_TRACE = "CASE WHEN user_id % 4 <> 0 THEN concat(CASE WHEN event_id % 2 = 0 THEN ' ' ELSE {tab} END, text) ELSE text END"
_TRACE_SQL = f"SELECT l.source, l.source_ord, l.line, {_TRACE.format(tab='chr(9)')} AS text" \
             f" FROM ({log_lines_sql()}) l JOIN events e USING (event_id)"


def trace_lines(spark, sf_dir):
    """Log lines with long runs of continuations."""
    users = table(spark, sf_dir, "events").select("event_id", "user_id")
    return log_lines(spark, sf_dir).join(users, "event_id").select(
        "source", "source_ord", "line", F.expr(_TRACE.format(tab="chr(9)")).alias("text"))


def fold_sql(lines: str, max_lines: int, partition: str = "source", order: str = "line") -> str:
    part = f"PARTITION BY {partition} " if partition else ""
    comma = f"{partition}, " if partition else ""
    return f"""SELECT arg_min(source, o) AS source, arg_min(source_ord, o) AS source_ord, arg_min(line, o) AS line,
  string_agg(text, chr(10) ORDER BY o) AS text FROM (
  SELECT *, (row_number() OVER (PARTITION BY {comma}run ORDER BY o) - 1) // {max_lines + 1} AS chunk FROM (
  SELECT *, row_number() OVER (ORDER BY source_ord, line) AS o,
    count(*) FILTER (left(text, 1) NOT IN (' ', chr(9))) OVER ({part}ORDER BY {order}) AS run FROM ({lines})))
  GROUP BY {comma}run, chunk"""


def _folded(df):
    return df.select("source", "line", "text")


@query("fold", f"SELECT source, line, text FROM ({fold_sql(_TRACE_SQL, 50)})")
def _fold(spark, sf_dir):
    return _folded(fold(trace_lines(spark, sf_dir)))


@query("fold_cap", f"SELECT source, line, text FROM ({fold_sql(_TRACE_SQL, 2)})")
def _fold_cap(spark, sf_dir):
    return _folded(fold(trace_lines(spark, sf_dir), max_lines=2))


@query("fold_gaps", f"SELECT source, line, text FROM ({fold_sql(f'SELECT * FROM ({_TRACE_SQL}) WHERE line % 7 <> 0', 2)})")
def _fold_gaps(spark, sf_dir):
    """Every seventh line is missing, so numbers have gaps, inside events too."""
    return _folded(fold(trace_lines(spark, sf_dir).filter("line % 7 <> 0"), max_lines=2))


@query("fold_cross_source", f"SELECT source, line, text FROM ({fold_sql(_TRACE_SQL, 3, '', 'source_ord, line')})")
def _fold_cross_source(spark, sf_dir):
    return _folded(fold(trace_lines(spark, sf_dir), max_lines=3, cross_source=True))


# --- filters ---------------------------------------------------------------------------------------------

_FILTERS = {
    "filter_level": (lambda: flt.min_level(lv.WARN), "level >= 1"),
    "filter_regex": (lambda: flt.raw_matches(PATTERN), PATTERN_SQL),
    "filter_since": (lambda: flt.since(SINCE), SINCE_SQL),
    "filter_until": (lambda: flt.until(UNTIL), UNTIL_SQL),
    "filter_all": (lambda: flt.LogFilter(lv.ERROR, PATTERN, SINCE, UNTIL).condition(),
                   f"level >= 2 AND {PATTERN_SQL} AND {SINCE_SQL} AND {UNTIL_SQL}"),
    "filter_options": (lambda: flt.LogFilter.from_options("warn", PATTERN, "36h", "2024-01-20T12:00:00+02:00", datetime(2024, 1, 12)).condition(),
                       f"level >= 1 AND {PATTERN_SQL} AND (ts IS NULL OR (ts >= TIMESTAMP '2024-01-10 12:00:00' AND ts <= TIMESTAMP '2024-01-20 10:00:00'))"),
}


@query("events_level_eq", f"{o.events_cte()} SELECT {EVENT_ROWS} FROM ev WHERE level_name = 'WARN'")
def _events_level_eq(spark, sf_dir):
    return event_rows(flt.level_is(events(spark, sf_dir), "WARN"))


def _register_filters():
    for name, (condition, where) in _FILTERS.items():
        def run(spark, sf_dir, condition=condition):
            return event_rows(events(spark, sf_dir).filter(condition()))

        query(name, f"{o.events_cte()} SELECT {EVENT_ROWS} FROM ev WHERE {where}")(run)


_register_filters()

_DOC_PATTERN = r"\bd[eé]\b|[[:digit:]]{3}$|^\W|(?i:ß|É)\S\b"


@query("filter_regex_documents", f"SELECT line, text FROM ({_DOC_LINES}) WHERE regexp_matches(text, {o.q(_DOC_PATTERN)})")
def _filter_regex_documents(spark, sf_dir):
    lines = _doc_lines(spark, sf_dir).select("line", F.col("text").alias("raw"))
    return lines.filter(flt.raw_matches(_DOC_PATTERN)).select("line", F.col("raw").alias("text"))


@query("events_search", f"{o.events_cte()} SELECT {EVENT_ROWS} FROM ev WHERE contains(lower(message), 'dead7')")
def _events_search(spark, sf_dir):
    return event_rows(flt.search_messages(events(spark, sf_dir), "DEAD7"))


# --- aggregates ------------------------------------------------------------------------------------------

@query("total_lines", f"{o.events_cte()} SELECT count(*) AS total_lines FROM ev WHERE level >= 1")
def _total_lines(spark, sf_dir):
    return agg.total_lines(events(spark, sf_dir).filter(flt.min_level(lv.WARN)))


@query("level_counts", f'{o.events_cte()} SELECT level_name, count(*) AS "count" FROM ev GROUP BY level_name')
def _level_counts(spark, sf_dir):
    return agg.level_counts(events(spark, sf_dir))


_LEVEL_ROWS = "(VALUES ('FATAL', 0), ('ERROR', 1), ('WARN', 2), ('INFO', 3), ('DEBUG', 4)) l(level, severity)"
@query("level_share", f"""{o.events_cte()}, tot AS (SELECT source, count(*) AS total FROM ev WHERE level >= 1 GROUP BY source),
rows AS (SELECT t.source, l.level, total, (SELECT count(*) FROM ev e WHERE e.source = t.source AND e.level_name = l.level
  AND e.level >= 1) AS c FROM tot t CROSS JOIN {_LEVEL_ROWS})
SELECT source, level, c AS "count", printf('%.2f', c / total * 100) AS pct, printf('%.1f', c / total * 100) AS pct1 FROM rows""")
def _level_share(spark, sf_dir):
    reports = agg.report(events(spark, sf_dir).filter(flt.min_level(lv.WARN)), by="source")
    return agg.level_shares(reports.select("source", "total_lines", "levels")).select(
        "source", "level", "count", "pct", "pct1")


@query("level_chart", f"""{o.events_cte()}, lc AS (SELECT level_name AS level, count(*) AS n FROM ev GROUP BY level_name)
SELECT level, n AS "count", printf('%.1f', n / (SELECT sum(n) FROM lc) * 100) AS pct FROM lc""")
def _level_chart(spark, sf_dir):
    return agg.level_chart(agg.report(events(spark, sf_dir))).select("level", "count", "pct")


@query("time_range", f"""{o.events_cte()} SELECT {o.ts_text('min(ts)')} AS first_line, {o.ts_text('max(ts)')} AS last_line,
  cast((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS bigint) AS duration_sec FROM ev""")
def _time_range(spark, sf_dir):
    return agg.time_range(events(spark, sf_dir)).select(ts_text("first_line"), ts_text("last_line"), "duration_sec")


_GROUP_ROWS = f'signature, sample, "count", {o.ts_text("first_seen")} AS first_seen, {o.ts_text("last_seen")} AS last_seen'


def _group_rows(df):
    return df.select("signature", "sample", "count", ts_text("first_seen"), ts_text("last_seen"))


@query("error_groups", f"""{o.events_cte()}{o.groups_cte()} SELECT signature, "count", {o.ts_text('last_seen')} AS last_seen FROM grp""")
def _error_groups(spark, sf_dir):
    return agg.error_groups(events(spark, sf_dir)).select("signature", "count", ts_text("last_seen"))


@query("ranked_groups", f"""{o.events_cte()}{o.groups_cte()} SELECT row_number() OVER (ORDER BY "count" DESC, signature) AS rank,
  signature, "count", {o.ts_text('last_seen')} AS last_seen FROM grp""")
def _ranked_groups(spark, sf_dir):
    """All groups in order, as the table that stands beside a report without a limit."""
    _, groups = agg.report_and_groups(events(spark, sf_dir))
    return groups.select("rank", "signature", "count", ts_text("last_seen"))


@query("group_first_last", f"{o.events_cte()}{o.groups_cte(by='source')} SELECT source, {_GROUP_ROWS} FROM grp")
def _group_first_last(spark, sf_dir):
    groups = agg.error_groups(events(spark, sf_dir), by=["source"])
    return groups.select("source", "signature", "sample", "count", ts_text("first_seen"), ts_text("last_seen"))


@query("top_errors", f"""{o.events_cte()}{o.groups_cte()} SELECT {_GROUP_ROWS} FROM grp ORDER BY grp."count" DESC, signature LIMIT 7""")
def _top_errors(spark, sf_dir):
    return _group_rows(agg.top_errors(events(spark, sf_dir), k=7))


@query("top_errors_first_k", f"""{o.events_cte()}{o.groups_cte()} SELECT {_GROUP_ROWS} FROM grp ORDER BY arrival LIMIT 4""")
def _top_errors_first_k(spark, sf_dir):
    return _group_rows(agg.top_errors(events(spark, sf_dir), k=4, mode=agg.FIRST_K))


def report_cte(k: int = 10, first_k: bool = False, by_source: bool = False, source: str = "stdin") -> str:
    """CTE ``rep`` on top of ``sel``, the chosen events: one row per report."""
    label = "source" if by_source else o.q(source)
    keep = "arrival" if first_k else '"count" DESC, signature'
    limit = f"WHERE keep_rank <= {k}" if k else ""
    return f""",
sg AS (SELECT {label} AS rsource, level, level_name, ts, message, source_ord, line,
  CASE WHEN level >= 2 THEN {o.normalize_sql('message')} END AS signature FROM sel),
rt AS (SELECT rsource, count(*) AS total_lines, min(ts) AS first_line, max(ts) AS last_line FROM sg GROUP BY rsource),
lc AS (SELECT rsource, level_name, count(*) AS n FROM sg GROUP BY rsource, level_name),
lm AS (SELECT rsource, map_from_entries(list({{'k': level_name, 'v': n}} ORDER BY level_name)) AS levels FROM lc GROUP BY rsource),
gr AS (SELECT rsource, signature, arg_min(message, (source_ord, line)) AS sample, count(*) AS "count",
  arg_min_null(ts, (source_ord, line)) AS first_seen, max(ts) AS last_seen, min((source_ord, line)) AS arrival
  FROM sg WHERE signature IS NOT NULL GROUP BY rsource, signature),
kr AS (SELECT *, row_number() OVER (PARTITION BY rsource ORDER BY {keep}) AS keep_rank FROM gr),
kk AS (SELECT *, row_number() OVER (PARTITION BY rsource ORDER BY "count" DESC, signature) AS rk FROM kr {limit}),
te AS (SELECT rsource, list({{'signature': signature, 'sample': sample, 'count': "count",
  'first_seen': coalesce({o.rfc3339_sql('first_seen')}, '0001-01-01T00:00:00Z'),
  'last_seen': coalesce({o.rfc3339_sql('last_seen')}, '0001-01-01T00:00:00Z')}} ORDER BY rk) AS top_errors FROM kk GROUP BY rsource),
rep AS (SELECT rt.rsource AS source, total_lines, levels, coalesce(top_errors, []) AS top_errors, first_line, last_line
  FROM rt JOIN lm USING (rsource) LEFT JOIN te USING (rsource))"""


def _report_rows(reports: DataFrame) -> DataFrame:
    groups = F.transform("top_errors", lambda g: F.struct(
        g["signature"].alias("signature"), g["sample"].alias("sample"), g["count"].alias("count"),
        F.coalesce(rfc3339(g["first_seen"]), F.lit("0001-01-01T00:00:00Z")).alias("first_seen"),
        F.coalesce(rfc3339(g["last_seen"]), F.lit("0001-01-01T00:00:00Z")).alias("last_seen")))
    return reports.select(
        "source", "total_lines", F.to_json("levels").alias("levels"), F.to_json(groups).alias("top_errors"),
        ts_text("first_line"), ts_text("last_line"))


REPORT_ROWS = "source, total_lines, cast(to_json(levels) AS varchar) AS levels, cast(to_json(top_errors) AS varchar)" \
              f" AS top_errors, {o.ts_text('first_line')} AS first_line, {o.ts_text('last_line')} AS last_line"


def _selected(where: str = "true", lines: str | None = None) -> str:
    return o.events_cte(lines, tail=f", sel AS (SELECT * FROM ev WHERE {where})")


@query("report", f"{_selected()}{report_cte()} SELECT {REPORT_ROWS} FROM rep")
def _report(spark, sf_dir):
    return _report_rows(agg.report(events(spark, sf_dir)))


@query("report_first_k", f"{_selected()}{report_cte(k=5, first_k=True)} SELECT {REPORT_ROWS} FROM rep")
def _report_first_k(spark, sf_dir):
    return _report_rows(agg.report(events(spark, sf_dir), k=5, mode=agg.FIRST_K))


@query("report_by_source", f"{_selected()}{report_cte(by_source=True, k=10)} SELECT {REPORT_ROWS} FROM rep")
def _report_by_source(spark, sf_dir):
    return _report_rows(agg.report(events(spark, sf_dir), k=10, by="source"))


@query("report_rollup", f"""{_selected()}{report_cte(by_source=True)} SELECT count(*) AS reports,
  count(*) FILTER (source <> 'app-3.log') AS complete, cast(sum(total_lines) FILTER (source <> 'app-3.log') AS bigint) AS total_lines,
  cast(sum(coalesce(levels['ERROR'], 0) + coalesce(levels['FATAL'], 0)) FILTER (source <> 'app-3.log') AS bigint) AS total_errors
FROM rep""")
def _report_rollup(spark, sf_dir):
    reports = agg.report(events(spark, sf_dir), by="source")
    status = F.when(F.col("source") == "app-3.log", "running").otherwise("complete")
    return agg.report_rollup(reports.withColumn("status", status))


@query("report_search", f"""SELECT source AS file_name, CASE WHEN source_ord % 2 = 0 THEN 'complete' ELSE 'error' END AS status,
  {o.ts_text('min(ts)')} AS created_at FROM ({o.events_cte()} SELECT * FROM ev) GROUP BY source, source_ord
  HAVING contains(lower(source), 'comp') OR source_ord % 2 = 0""")
def _report_search(spark, sf_dir):
    reports = events(spark, sf_dir).groupBy("source", "source_ord").agg(F.min("ts").alias("created_at")).select(
        F.col("source").alias("file_name"),
        F.when(F.col("source_ord") % 2 == 0, "complete").otherwise("error").alias("status"), "created_at")
    return flt.search_reports(reports, "COMP").select("file_name", "status", ts_text("created_at"))


@query("stat_cards", f"""{o.events_cte()} SELECT count(*) AS total, count(*) FILTER (level = 2) AS errors,
  count(*) FILTER (level = 1) AS warnings, count(*) FILTER (level = 0) AS infos FROM ev""")
def _stat_cards(spark, sf_dir):
    return agg.stat_cards(events(spark, sf_dir))


# --- order and paging ------------------------------------------------------------------------------------

@query("first_n", f"{o.events_cte()} SELECT {EVENT_ROWS} FROM ev WHERE level >= 1 ORDER BY source_ord, ev.line LIMIT 10")
def _first_n(spark, sf_dir):
    return event_rows(first_n(events(spark, sf_dir).filter(flt.min_level(lv.WARN))))


@query("events_page", f"""{o.events_cte()} SELECT {EVENT_ROWS}, (SELECT count(*) FROM ev) AS total FROM ev
ORDER BY source_ord, ev.line LIMIT 50 OFFSET 200""")
def _events_page(spark, sf_dir):
    return event_rows(commands.page(log_lines(spark, sf_dir), offset=200, limit=50, now=NOW), "total")


@query("events_page_level", f"""{o.events_cte()} SELECT {EVENT_ROWS}, (SELECT count(*) FROM ev WHERE level >= 1 AND {PATTERN_SQL}) AS total
FROM ev WHERE level >= 1 AND {PATTERN_SQL} ORDER BY source_ord, ev.line LIMIT 30 OFFSET 10""")
def _events_page_level(spark, sf_dir):
    where = flt.LogFilter(lv.WARN, PATTERN)
    return event_rows(commands.page(log_lines(spark, sf_dir), where, 10, 30, NOW), "total")


@query("events_page_regex", f"""{o.events_cte()} SELECT {EVENT_ROWS}, (SELECT count(*) FROM ev WHERE {PATTERN_SQL}) AS total
FROM ev WHERE {PATTERN_SQL} ORDER BY source_ord, ev.line LIMIT 30 OFFSET 10""")
def _events_page_regex(spark, sf_dir):
    return event_rows(commands.page(log_lines(spark, sf_dir), flt.LogFilter(pattern=PATTERN), 10, 30, NOW), "total")


@query("events_page_deep", f"{o.events_cte()} SELECT {EVENT_ROWS} FROM ev ORDER BY source_ord, ev.line LIMIT 60 OFFSET 700")
def _events_page_deep(spark, sf_dir):
    return event_rows(page(events(spark, sf_dir), 700, 60))


# --- commands --------------------------------------------------------------------------------------------

def _sources() -> list[str]:
    return [f"app-{i}.log" for i in range(SOURCES)]


@query("cmd_scan", f"{_selected(SINCE_SQL)}{report_cte(source='app-0.log')} SELECT {REPORT_ROWS} FROM rep")
def cmd_scan(spark, sf_dir):
    where = flt.LogFilter(since=SINCE)
    return _report_rows(commands.scan(log_lines(spark, sf_dir), where, sources=_sources(), now=NOW))


@query("cmd_scan_fold",
       f"{_selected('true', fold_sql(_TRACE_SQL, 50))}{report_cte(by_source=True, k=3)} SELECT {REPORT_ROWS} FROM rep")
def _cmd_scan_fold(spark, sf_dir):
    return _report_rows(commands.scan(trace_lines(spark, sf_dir), k=3, by="source", fold=True, now=NOW))


@query("cmd_top", f"{_selected('level >= 2')}{report_cte(source='app-0.log')} SELECT {REPORT_ROWS} FROM rep")
def _cmd_top(spark, sf_dir):
    return _report_rows(commands.top(log_lines(spark, sf_dir), sources=_sources(), now=NOW))


@query("cmd_errors", f"{o.events_cte()} SELECT {EVENT_ROWS} FROM ev WHERE level >= 2 ORDER BY source_ord, ev.line LIMIT 25")
def _cmd_errors(spark, sf_dir):
    return event_rows(commands.errors(log_lines(spark, sf_dir), n=25, now=NOW))


@query("first_of_files", f"""{o.events_cte()} SELECT {EVENT_ROWS} FROM ev WHERE level >= 2
  ORDER BY source_ord, ev.line LIMIT 25""")
def _first_of_files(spark, sf_dir):
    """The first errors of files, read in parts from 16 KB on until there are enough."""
    folder = scratch_dir(spark)
    write_logs(log_lines(spark, sf_dir), folder).write.format("noop").mode("overwrite").save()
    found, read = commands.first_of_files(
        spark, [f"{folder}/app-*.log"], flt.LogFilter(lv.ERROR), 25, now=NOW, first_bytes=1 << 14, range_bytes=1 << 12)
    return event_rows(found.withColumn("source", _file_name()))


@query("progress", f"{o.events_cte()} SELECT count(*) AS parsed, count(*) FILTER (WHERE level >= 2) AS matched FROM ev")
def _progress(spark, sf_dir):
    """What was observed while levels were counted."""
    seen = Observation("progress")
    counted = agg.level_counts(agg.observe_progress(events(spark, sf_dir), F.col("level") >= lv.ERROR, seen))
    counted.write.format("noop").mode("overwrite").save()
    return agg.progress_rows(spark, seen)


@query("cmd_errors_fold", f"""{o.events_cte(fold_sql(_TRACE_SQL, 50))} SELECT {EVENT_ROWS} FROM ev WHERE level >= 2
ORDER BY source_ord, ev.line LIMIT 25""")
def _cmd_errors_fold(spark, sf_dir):
    return event_rows(commands.errors(trace_lines(spark, sf_dir), n=25, now=NOW, fold=True))


@query("cmd_grep", f"{o.events_cte()} SELECT {EVENT_ROWS} FROM ev WHERE {PATTERN_SQL} ORDER BY source_ord, ev.line LIMIT 20")
def _cmd_grep(spark, sf_dir):
    return event_rows(commands.grep(log_lines(spark, sf_dir), PATTERN, n=20, now=NOW))


@query("cmd_analyze", f"{o.events_cte()} SELECT {EVENT_ROWS} FROM ev WHERE level >= 2 AND {PATTERN_SQL} AND {UNTIL_SQL}")
def _cmd_analyze(spark, sf_dir):
    options = commands.AnalyzeOptions("errors", "warn", PATTERN, 5, "", "2024-01-20T00:00:00Z")
    return event_rows(commands.analyze(log_lines(spark, sf_dir), options, "app", NOW))


def _analyzed(command: str):
    options = commands.AnalyzeOptions(command, "warn", PATTERN if command == "grep" else "", 5, fold=True)
    return lambda spark, sf_dir: commands.analyze(trace_lines(spark, sf_dir), options, "app", NOW)


_FOLDED_SQL = fold_sql(_TRACE_SQL, 50)


@query("analyze_scan", f"{_selected('level >= 1', _FOLDED_SQL)}{report_cte(source='app', k=5)} SELECT {REPORT_ROWS} FROM rep")
def _analyze_scan(spark, sf_dir):
    return _report_rows(_analyzed("scan")(spark, sf_dir))


@query("analyze_top", f"{_selected('level >= 2', _FOLDED_SQL)}{report_cte(source='app', k=5)} SELECT {REPORT_ROWS} FROM rep")
def _analyze_top(spark, sf_dir):
    return _report_rows(_analyzed("top")(spark, sf_dir))


@query("analyze_grep", f"{o.events_cte(_FOLDED_SQL)} SELECT {EVENT_ROWS} FROM ev WHERE level >= 1 AND {PATTERN_SQL}")
def _analyze_grep(spark, sf_dir):
    return event_rows(_analyzed("grep")(spark, sf_dir))


# --- streams ---------------------------------------------------------------------------------------------

@query("watch_live", f"{o.events_cte()} SELECT {EVENT_ROWS} FROM ev WHERE level >= 1 AND {PATTERN_SQL}")
def _watch_live(spark, sf_dir):
    """Matching events of a stream, appended to files and read back."""
    path = scratch_dir(spark)
    found = watch_events(log_lines_stream(spark, sf_dir), flt.LogFilter(lv.WARN, PATTERN), now=NOW)
    writer = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return event_rows(spark.read.schema(found.schema).parquet(path))


@query("watch_report", f"{_selected()}{report_cte(source='app-0.log')} SELECT {REPORT_ROWS} FROM rep")
def _watch_report(spark, sf_dir):
    """Last report of a watched stream."""
    path = scratch_dir(spark)
    watch_report(
        watch_events(log_lines_stream(spark, sf_dir), now=NOW),
        lambda report, number: report.write.mode("overwrite").parquet(path), path + "-progress", sources=_sources(),
    ).awaitTermination()
    return _report_rows(spark.read.parquet(path))


@query("read_many", f"SELECT source, line, text FROM ({log_lines_sql()}) WHERE source_ord < 6")
def _read_many(spark, sf_dir):
    """Files in folders of their own, some packed, two binary: listed, probed and read by tasks."""
    folder = scratch_dir(spark)
    lines = log_lines(spark, sf_dir)
    body = F.when((F.col("source_ord") >= 6) & (F.col("line") == 1), F.concat("text", F.lit("\0"))).otherwise(F.col("text"))
    for packed in (True, False):
        for half in (0, 1):
            some = lines.filter(F.col("source_ord").between(2, 5) == packed).filter(F.col("source_ord") % 2 == half).withColumn("text", body)
            write_logs(some, f"{folder}/host-{half}", gzip=packed).write.format("noop").mode("overwrite").save()
    found = read_many(spark, [f"{folder}/host-{i % 2}/app-{i}.*" for i in range(4)] + [f"{folder}/*/app-[4567].log"], range_bytes=1 << 16)
    return found.select(_file_name().alias("source"), "line", "text")


@query("read_kinds", f"SELECT source, line, text FROM ({log_lines_sql()}) WHERE source_ord < 6")
def _read_kinds(spark, sf_dir):
    """Plain files, gzip files by name and by content alone, and files with a NUL byte, which are skipped."""
    folder = scratch_dir(spark)
    lines = log_lines(spark, sf_dir)
    name = F.when(F.col("source_ord").isin(2, 3), F.concat("source", F.lit(".gz"))).otherwise(F.col("source"))
    body = F.when((F.col("source_ord") >= 6) & (F.col("line") == 1), F.concat("text", F.lit("\0"))).otherwise(F.col("text"))
    for packed in (True, False):
        some = lines.filter(F.col("source_ord").between(2, 5) == packed).withColumns({"source": name, "text": body})
        write_logs(some, folder, gzip=packed).write.format("noop").mode("overwrite").save()
    return read_lines(spark, f"{folder}/app-*").select(
        F.regexp_replace(_file_name(), "[.]gz$", "").alias("source"), "line", "text")


def _file_name(source: str = "source") -> Column:
    return F.element_at(F.split(source, "/"), -1)


def _grown_tail(spark, lines, follow, **options) -> DataFrame:
    """What ``follow`` makes of the lines of tailed files, over two runs of its query: files there in part, then whole.

    The first half ends within a line.  The second run resumes where the first one was.
    """
    folder, out = scratch_dir(spark), scratch_dir(spark)
    half = lines.groupBy("source").agg(F.floor(F.max("line") / 2).alias("_half"))
    part = lines.join(half, "source").filter("line <= _half")
    part = part.withColumn("text", F.when(F.col("line") == F.col("_half"), F.substring("text", 1, 3)).otherwise(F.col("text")))
    for some, ends in ((part, False), (lines, True)):
        write_logs(some, folder, last_newline=ends).write.format("noop").mode("overwrite").save()
        found = follow(tail_lines(spark, [f"{folder}/*.log"], from_end=False, **options))
        writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-progress")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


@query("tail_lines", f"SELECT source, line, text FROM ({log_lines_sql()})")
def _tail_lines(spark, sf_dir):
    """Lines of files that grow between two runs, read in ranges of 64 KB."""
    rows = _grown_tail(spark, log_lines(spark, sf_dir), lambda lines: lines, range_bytes=1 << 16)
    return rows.select(_file_name().alias("source"), "line", "text")


@query("tail_follow", f"""WITH l AS ({log_lines_sql()}) SELECT source, line, text FROM l
  UNION ALL SELECT source, line, text FROM l WHERE source = 'app-0.log' AND line <= 5""")
def _tail_follow(spark, sf_dir):
    """Files that start, grow and shrink under one running query, which admits a megabyte at a time."""
    folder, out = scratch_dir(spark), scratch_dir(spark)
    lines = log_lines(spark, sf_dir)
    steps = [lines.filter("source_ord < 4 AND line <= 1000"), lines, lines.filter("source_ord = 0 AND line <= 5")]
    share = 1 << 20
    found = tail_lines(spark, [f"{folder}/app-?.log"], from_end=False, max_bytes=share)
    running = None
    for step in steps:
        write_logs(step, folder).write.format("noop").mode("overwrite").save()
        if running is None:
            writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-progress")
            with sized_for(spark, share):
                running = writer.trigger(processingTime="0 seconds").start()
        running.processAllAvailable()
    running.stop()
    return spark.read.schema(found.schema).parquet(out).select(_file_name().alias("source"), "line", "text")


@query("fold_stream", f"""SELECT source, line, text FROM (SELECT *, max(line) OVER (PARTITION BY source) AS last
  FROM ({fold_sql(_TRACE_SQL, 3)})) WHERE line < last""")
def _fold_stream(spark, sf_dir):
    """Events of files that grow; the last event of each file still waits for its next line."""
    rows = _grown_tail(spark, trace_lines(spark, sf_dir), lambda lines: fold_stream(lines, 3, None, block_bits=8), range_bytes=1 << 16)
    return rows.select(_file_name().alias("source"), "line", "text")


@query("watch_report_tail", f"{_selected()}{report_cte(source='app-0.log')} SELECT {REPORT_ROWS} FROM rep")
def _watch_report_tail(spark, sf_dir):
    """Last report of a query that watches growing files."""
    folder, out = scratch_dir(spark), scratch_dir(spark)
    lines = log_lines(spark, sf_dir)
    for some in (lines.filter("line <= 500"), lines):
        write_logs(some, folder).write.format("noop").mode("overwrite").save()
        tailed = tail_lines(spark, [f"{folder}/app-{i}.log" for i in range(SOURCES)], from_end=False)
        watch_report(
            watch_events(tailed, now=NOW), lambda report, number: report.write.mode("overwrite").parquet(out), out + "-progress",
            sources=_sources(),
        ).awaitTermination()
    return _report_rows(spark.read.parquet(out))


# --- sinks -----------------------------------------------------------------------------------------------

_SPAN_JSON = "to_json({'first': " + o.rfc3339_sql("first_line") + ", 'last': " + o.rfc3339_sql("last_line") + \
             ", 'duration_sec': (epoch_us(last_line) - epoch_us(first_line)) // 1000000})"
_REPORT_JSON = "concat('{\"source\":', to_json(source), ',\"total_lines\":', total_lines, ',\"time_range\":', " + _SPAN_JSON + \
               ", ',\"levels\":', to_json(levels), ',\"top_errors\":', to_json(top_errors), '}')"


@query("report_json", f"{_selected()}{report_cte(by_source=True)} SELECT {o.escape_sql(_REPORT_JSON)} AS json FROM rep")
def _report_json(spark, sf_dir):
    return rep_out.report_json(agg.report(events(spark, sf_dir), by="source"))


@query("report_roundtrip", f"{_selected()}{report_cte(by_source=True)} SELECT {REPORT_ROWS} FROM rep")
def _report_roundtrip(spark, sf_dir):
    documents = rep_out.report_document(agg.report(events(spark, sf_dir), by="source"))
    return _report_rows(rep_out.read_report(documents))


_EVENT_JSON = "to_json({'timestamp': coalesce(" + o.rfc3339_sql("ts") + ", ''), 'level': level_name, 'source': source," \
              " 'message': message, 'line': line})"


@query("events_ndjson", f"{o.events_cte()} SELECT {o.escape_sql(_EVENT_JSON)} AS json FROM ev")
def _events_ndjson(spark, sf_dir):
    return ev_out.events_json(events(spark, sf_dir))


@query("events_csv", f"""{o.events_cte(fold_sql(_TRACE_SQL, 50))} SELECT coalesce({o.rfc3339_sql('ts')}, '') AS "timestamp",
  level_name AS level, source, message FROM ev""")
def _events_csv(spark, sf_dir):
    """Folded events written as CSV files and read back."""
    path = scratch_dir(spark)
    folded = commands.events_of(trace_lines(spark, sf_dir), fold=True, now=NOW)
    ev_out.write_csv(ev_out.events_csv(folded), path)
    back = spark.read.csv(path, header=True, schema="timestamp string, level string, source string, message string",
                          escape='"', multiLine=True, nullValue="\x00")
    return back.withColumns({c: F.coalesce(c, F.lit("")) for c in back.columns})


@query("event_text", f"""{o.events_cte()} SELECT concat(coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S'), ''), ' ', level_name, ' ',
  source, ':', line, ' ', message) AS text FROM ev""")
def _event_text(spark, sf_dir):
    return ev_out.event_text(events(spark, sf_dir))


_TEXT_LEVELS = ", ".join(
    f"chr(10), '{n.ljust(7)}', rpad(cast(coalesce(levels['{n}'], 0) AS varchar), w, ' '),"
    f" printf('%.1f', coalesce(levels['{n}'], 0) / greatest(total_lines, 1) * 100), '%'"
    for n in rep_out.TEXT_ORDER
)
_LONG = "CASE WHEN s >= 3600 THEN concat(s // 3600, 'h', s % 3600 // 60, 'm') WHEN s >= 60 THEN concat(s // 60, 'm') ELSE '' END"
_GROUP_LINES = """(SELECT string_agg(concat(rpad(concat({p}, i, '.'), cast(length(cast(len(top_errors) AS varchar)) + {pl} AS int), ' '),
  rpad(g.signature, sw, ' '), rpad(concat(g."count", 'x'), cw, ' '), '[', substr(g.first_seen, 12, 8), ' - ', substr(g.last_seen, 12, 8), ']'),
  chr(10) ORDER BY i) FROM (SELECT unnest(top_errors) AS g, generate_subscripts(top_errors, 1) AS i))"""
_WIDTHS = """, rw AS (SELECT *, cast(list_max(list_transform(top_errors, lambda g: length(g.signature))) + 2 AS int) AS sw,
  cast(list_max(list_transform(top_errors, lambda g: length(cast(g."count" AS varchar)))) + 3 AS int) AS cw,
  cast(greatest(5, list_max(list_transform(map_values(levels), lambda x: length(cast(x AS varchar))))) + 2 AS int) AS w,
  (epoch_us(last_line) - epoch_us(first_line) + 500000) // 1000000 AS s FROM rep)"""


@query("report_text", f"""{_selected()}{report_cte(by_source=True)}{_WIDTHS} SELECT source, concat('File:         ', source, chr(10),
  'Total lines:  ', total_lines, chr(10), 'Time range:   ', strftime(first_line, '%Y-%m-%d %H:%M:%S'), ' — ',
  strftime(last_line, '%Y-%m-%d %H:%M:%S'), ' (', {_LONG}, s % 60, 's)', chr(10), chr(10), 'Level  ', rpad('Count', w, ' '), '%', chr(10),
  '─────  ', rpad('─────', w, ' '), '────', {_TEXT_LEVELS}, chr(10), chr(10), 'Top errors:', chr(10),
  {_GROUP_LINES.format(p="' '", pl=4)}) AS text FROM rw""")
def _report_text(spark, sf_dir):
    return rep_out.report_text(agg.report(events(spark, sf_dir), by="source"))


@query("top_text", f"""{_selected('level >= 2')}{report_cte(by_source=True)}{_WIDTHS} SELECT source,
  {_GROUP_LINES.format(p="''", pl=3)} AS text FROM rw""")
def _top_text(spark, sf_dir):
    return rep_out.top_text(commands.top(log_lines(spark, sf_dir), by="source", now=NOW))


_PROMPT_LEVELS = ", ".join(
    f"CASE WHEN levels['{n}'] > 0 THEN concat('  {n}: ', levels['{n}'], chr(10)) ELSE '' END" for n in lv.BY_SEVERITY
)


@query("prompt_text", f"""{_selected()}{report_cte(by_source=True)} SELECT source, concat({o.q(rep_out.PROMPT_TASK)}, chr(10), chr(10),
  'Log source: ', source, chr(10), 'Total lines analyzed: ', total_lines, chr(10), 'Time range: ',
  strftime(first_line, '%Y-%m-%d %H:%M:%S'), ' — ', strftime(last_line, '%Y-%m-%d %H:%M:%S'), chr(10), chr(10),
  'Level distribution:', chr(10), {_PROMPT_LEVELS}, chr(10), 'Top error patterns:', chr(10),
  (SELECT string_agg(concat(i, '. [', g."count", 'x] ', g.signature, chr(10), '   Sample: ', g.sample, chr(10)), '' ORDER BY i)
   FROM (SELECT unnest(top_errors) AS g, generate_subscripts(top_errors, 1) AS i))) AS prompt FROM rep""")
def _prompt_text(spark, sf_dir):
    return rep_out.prompt_text(agg.report(events(spark, sf_dir), by="source"))


# --- admission and expiry --------------------------------------------------------------------------------

_LIMIT, _WINDOW = 2, timedelta(hours=10)
ADMISSION_SQL = f"""WITH RECURSIVE s AS (SELECT event_id, user_id, epoch_us(ts) AS t,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
a AS (SELECT event_id, user_id, t, i, true AS admitted, [t] AS held FROM s WHERE i = 1
  UNION ALL
  SELECT s.event_id, s.user_id, s.t, s.i, len(v) < {_LIMIT}, CASE WHEN len(v) < {_LIMIT} THEN list_append(v, s.t) ELSE v END
  FROM (SELECT a.user_id, a.i, s.event_id, s.t, list_filter(a.held, lambda x: x > s.t - 36000000000) AS v
        FROM a JOIN s ON s.user_id = a.user_id AND s.i = a.i + 1) n JOIN s ON s.event_id = n.event_id)"""


def _admitted(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return adm.admission(events, "user_id", "ts", _LIMIT, _WINDOW, ["event_id"])


@query("admission", f"{ADMISSION_SQL} SELECT event_id, user_id, admitted FROM a")
def _admission(spark, sf_dir):
    return _admitted(spark, sf_dir).select("event_id", "user_id", "admitted")


_NULL_KEY = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE 9007199254740993 + user_id END"


@query("admission_null_keys", ADMISSION_SQL.replace(
    "SELECT event_id, user_id, epoch_us(ts) AS t,", f"SELECT event_id, coalesce({_NULL_KEY}, -1) AS user_id, epoch_us(ts) AS t,").replace(
    "PARTITION BY user_id", f"PARTITION BY {_NULL_KEY}") + " SELECT event_id, admitted FROM a")
def _admission_null_keys(spark, sf_dir):
    """Keys beyond what a double can tell apart, some of them null."""
    keyed = table(spark, sf_dir, "events").select("event_id", "ts", F.expr(_NULL_KEY.replace("9007199254740993", "9007199254740993L")).alias("k"))
    return adm.admission(keyed, "k", "ts", _LIMIT, _WINDOW, ["event_id"]).select("event_id", "admitted")


@query("admission_stream", f"{ADMISSION_SQL} SELECT event_id, user_id, admitted FROM a")
def _admission_stream(spark, sf_dir):
    """The same decisions over a stream of the table's files, written batch by batch and read back."""
    path = scratch_dir(spark)
    events = table_stream(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    decided = admission_stream(events, "user_id", "ts", _LIMIT, _WINDOW, ["event_id"])
    writer = decided.writeStream.outputMode("update").option("checkpointLocation", path + "-progress")
    writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")).trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(decided.schema).parquet(path).select("event_id", "user_id", "admitted")


_LATENESS = timedelta(days=1)


@query("admission_late", f"""{ADMISSION_SQL} SELECT event_id, user_id, admitted FROM a
WHERE t < (SELECT epoch_us(max(ts)) // 1000 * 1000 FROM events) - {_LATENESS // timedelta(microseconds=1)}""")
def _admission_late(spark, sf_dir):
    """Events up to a day out of order, in six batches; those the watermark has passed have the decisions of the batch form."""
    path = scratch_dir(spark)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    delay = F.pmod(F.xxhash64("event_id"), F.lit(_LATENESS // timedelta(seconds=1)))
    arrival = F.unix_timestamp("ts") + delay
    ends = events.agg(F.min(arrival).alias("_low"), F.max(arrival).alias("_high"))
    batch = F.floor((arrival - F.col("_low")) * 6 / (F.col("_high") - F.col("_low") + 1))
    arrived = events.crossJoin(F.broadcast(ends)).withColumn("batch", batch)  # one row
    for n in range(6):
        arrived.filter(F.col("batch") == n).select(*events.columns).repartition(1).write.mode("append").parquet(path + "-in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path + "-in")
    decided = admission_stream(stream, "user_id", "ts", _LIMIT, _WINDOW, ["event_id"], lateness=_LATENESS)
    writer = decided.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(decided.schema).parquet(path).select("event_id", "user_id", "admitted")


@query("active_keys", f"""{ADMISSION_SQL} SELECT user_id, strftime(make_timestamp(max(t)), '%Y-%m-%d %H:%M:%S.%f') AS last_admitted
FROM a WHERE admitted GROUP BY user_id HAVING max(t) > epoch_us(TIMESTAMP '2024-01-30 00:00:00') - 36000000000""")
def _active_keys(spark, sf_dir):
    active = adm.active_keys(_admitted(spark, sf_dir), "user_id", "ts", datetime(2024, 1, 30), _WINDOW)
    return active.select("user_id", ts_text("last_admitted"))


@query("idle_expiry", f"""SELECT user_id, {o.ts_text('max(ts)')} AS last_access,
  epoch_us(TIMESTAMP '2024-01-30 00:00:00') - epoch_us(max(ts)) <= 36000000000 AS alive FROM events GROUP BY user_id""")
def _idle_expiry(spark, sf_dir):
    out = adm.idle_expiry(table(spark, sf_dir, "events"), "user_id", "ts", datetime(2024, 1, 30), _WINDOW)
    return out.select("user_id", ts_text("last_access"), "alive")


_FORWARDED = """CASE cast(event_id % 5 AS int) WHEN 0 THEN '' WHEN 1 THEN concat(' 10.0.0.', cast(user_id AS string), ' , 10.1.1.1')
  WHEN 2 THEN ',10.9.9.9' WHEN 3 THEN concat('10.2.0.', cast(user_id AS string)) END"""
_ADDRESS = "concat(CASE WHEN user_id % 3 = 0 THEN '[::1]' WHEN user_id % 3 = 1 THEN '10.3.0.1' ELSE 'host' END," \
           " CASE WHEN event_id % 2 = 0 THEN concat(':', cast(1000 + user_id AS string)) ELSE '' END)"


@query("client_key", f"""SELECT event_id, CASE WHEN coalesce(f, '') <> '' THEN trim(CASE WHEN strpos(f, ',') > 1
  THEN left(f, strpos(f, ',') - 1) ELSE f END) WHEN length(a) - strpos(reverse(a), ':') > 0 AND strpos(a, ':') > 0
  THEN left(a, length(a) - strpos(reverse(a), ':')) ELSE a END AS client
FROM (SELECT event_id, {_FORWARDED} AS f, {_ADDRESS} AS a FROM events)""")
def _client_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", client_key(F.expr(_FORWARDED), F.expr(_ADDRESS)).alias("client"))
