"""DuckDB statements that say what the registered queries must return."""

from __future__ import annotations

from emberlog.sources.tables import log_lines_sql

NOW = "2024-12-31 00:00:00"

# Timestamp patterns, RE2 syntax.
_MON = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
ISO = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?"
DATE_SPACE = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?"
SYSLOG = _MON + r"\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})"
APACHE = r"\d{2}/" + _MON + r"/\d{4}:\d{2}:\d{2}:\d{2}\s+\+\d{4}"
EPOCH = r"^\d{10}"

# Normalizer rewrites, RE2 syntax.
NORMALIZE = {
    "uuid": (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    "request": (r"\b(?:req|request|trace|span)[-_=][a-zA-Z0-9]{8,}\b", "<req>"),
    "ipv6": (r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|\b::1\b", "<ip>"),
    "ipv4": (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<ip>"),
    "hex": (r"\b0x[0-9a-fA-F]+\b", "<hex>"),
    "path": (r"""(?:/[^\s"')\]}:,;]*)+(?:\:\d+)?""", "<path>"),
    "hash": (r"\b[0-9a-fA-F]{40,}\b", "<hash>"),
    "number": (r"\b\d+\b", "<n>"),
}

# Markdown rewrites, RE2 syntax.
MARKDOWN = [
    (r"\*\*(.+?)\*\*", r"\1"), (r"__(.+?)__", r"\1"), (r"\*(.+?)\*", r"\1"), (r"_(.+?)_", r"\1"),
    (r"`(.+?)`", r"\1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^-{3,}$", ""),
]

# Level names and their aliases.
_KEYWORDS = {
    "FATAL": 3, "CRITICAL": 3, "PANIC": 3, "ERROR": 2, "WARN": 1, "WARNING": 1, "INFO": 0, "DEBUG": -1, "TRACE": -1,
}

WS = "concat(chr(9),chr(10),chr(11),chr(12),chr(13),' ',chr(133),chr(160),chr(5760),chr(8192),chr(8193),chr(8194)," \
     "chr(8195),chr(8196),chr(8197),chr(8198),chr(8199),chr(8200),chr(8201),chr(8202),chr(8232),chr(8233),chr(8239)," \
     "chr(8287),chr(12288))"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ts_text(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"


def normalize_sql(expr: str, names=tuple(NORMALIZE)) -> str:
    for name in names:
        pattern, placeholder = NORMALIZE[name]
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(placeholder)}, 'g')"
    return expr


def markdown_sql(expr: str) -> str:
    for pattern, replacement in MARKDOWN:
        expr = f"regexp_replace({expr}, {q(pattern)}, {q(replacement)}, 'g')"
    return expr


def level_sql(up: str, column: str) -> str:
    """CASE over the keywords; column is ``level``, ``pos`` or ``width``."""
    out = "CASE"
    for word, level in _KEYWORDS.items():
        pos = f"strpos({up}, '{word}')"
        value = {"level": level, "pos": pos, "width": len(word)}[column]
        out += (
            f" WHEN {pos} > 0 AND ({pos} = 1 OR NOT regexp_matches(substr({up}, {pos} - 1, 1), '[A-Z]'))"
            f" AND NOT regexp_matches(substr({up}, {pos} + {len(word)}, 1), '[A-Z]') THEN {value}"
        )
    return out + " END"


def level_name_sql(level: str) -> str:
    return (
        f"CASE {level} WHEN -1 THEN 'DEBUG' WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARN' WHEN 2 THEN 'ERROR'"
        f" WHEN 3 THEN 'FATAL' ELSE 'UNKNOWN' END"
    )


def iso_sql(m: str) -> str:
    base = f"try_cast(concat(substr({m}, 1, 10), ' ', substr({m}, 12, 8), regexp_extract({m}, '\\.\\d{{1,6}}')) AS timestamp)"
    minutes = f"(cast(substr({m}, -5, 2) AS int) * 60 + cast(substr({m}, -2, 2) AS int))"
    sign = f"(CASE substr({m}, -6, 1) WHEN '-' THEN -1 ELSE 1 END)"
    return (
        f"CASE WHEN {m} = '' OR regexp_matches({m}, 'T.*[+-]\\d{{4}}$') THEN NULL"
        f" WHEN regexp_matches({m}, 'T.*[+-]\\d{{2}}:\\d{{2}}$') THEN {base} - to_minutes({sign} * {minutes})"
        f" ELSE {base} END"
    )


def date_space_sql(m: str) -> str:
    return f"CASE WHEN {m} <> '' THEN try_cast(concat(substr({m}, 1, 19), regexp_extract({m}, '\\.\\d{{1,6}}')) AS timestamp) END"


def _month_sql(name: str) -> str:
    return f"lpad(cast((strpos('JanFebMarAprMayJunJulAugSepOctNovDec', {name}) + 2) // 3 AS string), 2, '0')"


def syslog_sql(m: str, now: str = NOW) -> str:
    day = f"lpad(regexp_extract({m}, '\\s(\\d{{1,2}})\\s', 1), 2, '0')"
    year = int(now[:4])

    def at(y, date=None):
        date = date or f"{_month_sql(f'substr({m}, 1, 3)')}, '-', {day}"
        return f"try_cast(concat('{y}-', {date}, ' ', substr({m}, -8, 8)) AS timestamp)"

    return (
        f"CASE WHEN {m} = '' THEN NULL WHEN {at(year)} > TIMESTAMP '{now}' + INTERVAL 24 HOUR"
        f" THEN coalesce({at(year - 1)}, {at(year - 1, q('03-01'))}) ELSE {at(year)} END"
    )


def apache_sql(m: str) -> str:
    base = (
        f"try_cast(concat(substr({m}, 8, 4), '-', {_month_sql(f'substr({m}, 4, 3)')}, '-', substr({m}, 1, 2), ' ',"
        f" substr({m}, 13, 8)) AS timestamp)"
    )
    return (
        f"CASE WHEN regexp_matches({m}, ':\\d{{2}} +\\+') AND cast(substr({m}, -4, 2) AS int) <= 24"
        f" AND cast(substr({m}, -2, 2) AS int) <= 60 THEN {base} - to_minutes(cast(substr({m}, -4, 2) AS int) * 60"
        f" + cast(substr({m}, -2, 2) AS int)) END"
    )


def epoch_sql(m: str) -> str:
    return f"CASE WHEN {m} <> '' THEN make_timestamp(cast({m} AS bigint) * 1000000) END"


def lines_cte(lines: str | None = None) -> str:
    return f"WITH lines AS ({lines or log_lines_sql()})"


def events_cte(lines: str | None = None, compat: bool = True, tail: str = "") -> str:
    """CTEs up to ``ev``: the parsed events of a table of lines."""
    cut = f"length({level_name_sql('level')})" if compat else "width"
    return f"""{lines_cte(lines)},
m AS (SELECT *, regexp_extract(text, {q(ISO)}) AS m1, regexp_extract(text, {q(DATE_SPACE)}) AS m2,
  regexp_extract(text, {q(SYSLOG)}) AS m3, regexp_extract(text, {q(APACHE)}) AS m4,
  regexp_extract(text, {q(EPOCH)}) AS m5 FROM lines),
v AS (SELECT *, {iso_sql('m1')} AS v1, {date_space_sql('m2')} AS v2, {syslog_sql('m3')} AS v3,
  {apache_sql('m4')} AS v4, {epoch_sql('m5')} AS v5 FROM m),
c AS (SELECT *, coalesce(v1, v2, v3, v4, v5) AS ts,
  CASE WHEN v1 IS NOT NULL THEN 'iso' WHEN v2 IS NOT NULL THEN 'date_space' WHEN v3 IS NOT NULL THEN 'syslog'
       WHEN v4 IS NOT NULL THEN 'apache' WHEN v5 IS NOT NULL THEN 'epoch' END AS ts_format,
  CASE WHEN v1 IS NOT NULL THEN m1 WHEN v2 IS NOT NULL THEN m2 WHEN v3 IS NOT NULL THEN m3
       WHEN v4 IS NOT NULL THEN m4 WHEN v5 IS NOT NULL THEN m5 ELSE '' END AS mt FROM v),
r AS (SELECT *, CASE WHEN mt = '' THEN text ELSE substr(text, strpos(text, mt) + length(mt)) END AS rest FROM c),
u AS (SELECT *, upper(rest) AS up FROM r),
h AS (SELECT *, coalesce({level_sql('up', 'level')}, 0) AS level, {level_sql('up', 'pos')} AS pos,
  {level_sql('up', 'width')} AS width FROM u),
k AS (SELECT *, pos - 1 + {cut} AS cut FROM h),
g AS (SELECT *, trim(ltrim(trim(CASE WHEN cut > 0 AND cut < length(rest) THEN substr(rest, cut + 1) ELSE rest END,
  {WS}), concat(':-[]() ', chr(9))), {WS}) AS bare FROM k),
ev AS (SELECT ts, ts_format, level, {level_name_sql('level')} AS level_name, source, source_ord,
  CASE WHEN bare = '' THEN trim(text, {WS}) ELSE bare END AS message, text AS raw, line FROM g){tail}"""


def groups_cte(where: str = "true", by: str = "") -> str:
    """CTE ``grp`` on top of ``ev``."""
    comma = by + ", " if by else ""
    return f""",
er AS (SELECT *, {normalize_sql('message')} AS signature FROM ev WHERE level >= 2 AND {where}),
grp AS (SELECT {comma}signature, arg_min(message, (source_ord, line)) AS sample, count(*) AS "count",
  arg_min_null(ts, (source_ord, line)) AS first_seen, max(ts) AS last_seen,
  min((source_ord, line)) AS arrival FROM er GROUP BY {comma}signature)"""


def rfc3339_sql(col: str) -> str:
    return (
        f"CASE WHEN {col} IS NOT NULL THEN concat(strftime({col}, '%Y-%m-%dT%H:%M:%S'),"
        f" regexp_replace(strftime({col}, '.%f'), '\\.?0+$', ''), 'Z') END"
    )


def escape_sql(json: str) -> str:
    return f"replace(replace(replace(cast({json} AS varchar), '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"
