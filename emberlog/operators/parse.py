"""Lines to events: timestamp, level and message of each line."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions import levels as lv
from emberlog.functions import timestamps as tm
from emberlog.functions.messages import message, tail

EVENT_COLUMNS = ["ts", "level", "level_name", "source", "source_ord", "message", "raw", "line"]

# A moment that means "no timestamp": its text is cut off the line all the same.
_ZERO_MOMENT = "0001-01-01 00:00:00Z"


def as_lines(df: DataFrame, text: str = "text", source: str = "stdin") -> DataFrame:
    """Any table with a text column as lines ``(source_ord, source, line, text, ...)``.

    Missing ``source``, ``source_ord`` and ``line`` columns are filled with a constant; lines that all
    carry the same number have no defined arrival order.
    """
    out = df if text == "text" else df.withColumnRenamed(text, "text")
    defaults = {"source": F.lit(source), "source_ord": F.lit(0), "line": F.lit(0).cast("bigint")}
    return out.withColumns({k: v for k, v in defaults.items() if k not in out.columns})


def _timestamp_columns(now: datetime | None, raw: str) -> list[str]:
    """Select list for ``ts``, ``ts_format`` and ``ts_match``, the timestamp's text ('' when there is none).

    Formats are tried in their order of preference; a candidate that is no valid moment falls through to
    the next one.  Each column builds on the ones before, so no candidate is searched for twice.
    """
    names = tm.formats(tm.now_sql(now))
    columns, before = [], []
    for name, (pattern, value) in names.items():
        search = tm.candidate(raw, pattern)
        if before:
            search = f"CASE WHEN coalesce({', '.join(before)}) IS NULL THEN {search} ELSE '' END"
        columns += [f"{search} AS _m_{name}", f"{value(f'_m_{name}')} AS _v_{name}"]
        before.append(f"_v_{name}")
    cases = "CASE" + "".join(f" WHEN _v_{n} IS NOT NULL THEN {{{n}}}" for n in names)
    return columns + [
        f"nullif(coalesce({', '.join(before)}), TIMESTAMP '{_ZERO_MOMENT}') AS ts",
        cases.format(**{n: f"'{n}'" for n in names}) + " END AS ts_format",
        cases.format(**{n: f"_m_{n}" for n in names}) + " ELSE '' END AS ts_match",
    ]


def _sealed(df: DataFrame, carried: list[str], computed: list[str]) -> DataFrame:
    """The same rows, the computed columns handed on through a generator of one row each.

    The optimizer copies a column's definition into every filter on it, but never through a generator, so
    what was computed is not computed again.  Generated code is cut into one method per generator, too,
    which keeps each below the size the JVM still compiles.
    """
    fields = ", ".join(f"'{c}', {c}" for c in computed)
    return df.selectExpr(*carried, f"inline(array(named_struct({fields})))")


def parse_events(
    lines: DataFrame, now: datetime | None = None, compat: bool = True, keep_format: bool = False
) -> DataFrame:
    """Events ``(ts, level, level_name, source, source_ord, message, raw, line)`` of a table of lines.

    ``now`` (UTC; the query's start if not given) settles the year of timestamps without one.  ``compat``
    cuts the message after as many characters as the level's own name has, even when the keyword was a
    longer alias (``WARNING: x`` gives ``ING: x``); otherwise the whole keyword is cut.
    """
    carried = ["source", "source_ord", "line", "text"]
    width = f"char_length({lv.name_of('level')})" if compat else "char_length(_keyword)"
    # A text that cannot be null keeps the generated code short enough to be compiled to machine code.
    known = as_lines(lines).selectExpr("source", "source_ord", "line", "coalesce(text, '') AS text")
    dated = _sealed(known.selectExpr(
        *carried, *_timestamp_columns(now, "text"),
        "CASE WHEN ts_match = '' THEN text ELSE substr(text, instr(text, ts_match) + char_length(ts_match)) END AS _rest",
    ), carried, ["ts", "ts_format", "_rest"])
    parsed = _sealed(dated.selectExpr(
        *carried, "ts", "ts_format", "_rest",
        f"{lv.fold_case('_rest')} AS _up",
        f"{lv.find_keyword('_up')} AS _keyword",
        f"{lv.rank_of('_keyword')} AS level",
        f"instr(_up, _keyword) - 1 + {width} AS _cut",
    ), [*carried, "ts", "ts_format"], ["level", "_rest", "_cut"])
    return parsed.selectExpr(
        "ts", "level", f"{lv.name_of('level')} AS level_name", "source", "source_ord",
        f"{message('text', tail('_rest', '_cut'))} AS message", "text AS raw", "line",
        *(["ts_format"] if keep_format else []),
    )
