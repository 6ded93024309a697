import json
from datetime import datetime
from pathlib import Path

import pytest

from emberlog.operators import aggregate as agg
from emberlog.operators import filters as flt
from emberlog.operators import paging
from emberlog.operators.parse import parse_events
from emberlog.plans import commands
from emberlog.sinks import events as ev_out
from emberlog.sinks import reports as rep_out

EVENT = "ts timestamp, level int, level_name string, source string, source_ord int, message string, raw string, line bigint"
NAMES = {-1: "DEBUG", 0: "INFO", 1: "WARN", 2: "ERROR", 3: "FATAL"}

# A sample log.
SAMPLE = """2026-07-08T10:12:33Z ERROR ledger sync stalled for 30s on node 10.0.0.5
2026-07-08T10:12:34Z ERROR ledger sync stalled for 30s on node 10.0.0.5
2026-07-08T10:12:35Z WARN spool at 85%, dropping old chunks
2026-07-08T10:12:36Z ERROR ledger sync stalled for 30s on node 10.0.0.6
2026-07-08T10:12:37Z ERROR upload refused: PUT /v2/parcels quota
2026-07-08T10:12:38Z ERROR ledger sync stalled for 30s on node 10.0.0.5
2026-07-08T10:12:39Z WARN heap at 92%, gc forced
2026-07-08T10:12:40Z ERROR upload refused: PUT /v2/parcels quota
2026-07-08T10:12:41Z FATAL shard map lost: no replica answers
2026-07-08T10:12:42Z INFO listener up on port 8080
2026-07-08T10:12:43Z DEBUG probe GET /alive took 42ms
2026-07-08T10:12:44Z ERROR upload refused: PUT /v2/parcels quota
2026-07-08T10:12:45Z WARN heap at 92%, gc forced
2026-07-08T10:12:46Z ERROR ledger sync stalled for 60s on node 10.0.0.7
2026-07-08T10:12:47Z ERROR ledger sync stalled for 30s on node 10.0.0.5""".split("\n")


def events(spark, rows):
    """Events from ``(seconds or None, level, message)`` in arrival order."""
    data = [
        (None if at is None else datetime.fromtimestamp(at), level, NAMES[level], "s", 0, message, message, i)
        for i, (at, level, message) in enumerate(rows, 1)
    ]
    return spark.createDataFrame(data, EVENT).repartition(3)


@pytest.fixture
def sample(lines):
    return lines([(0, "errors.log", i, t) for i, t in enumerate(SAMPLE, 1)])


def test_sample_report(sample):
    r = commands.scan(sample, sources=["errors.log"]).first()
    assert (r.source, r.sources, r.total_lines) == ("errors.log", ["errors.log"], 15)
    assert r.levels == {"DEBUG": 1, "ERROR": 9, "FATAL": 1, "INFO": 1, "WARN": 3}
    assert [(g.signature, g["count"], str(g.first_seen)[11:], str(g.last_seen)[11:]) for g in r.top_errors] == [
        ("ledger sync stalled for 30s on node <ip>", 5, "10:12:33", "10:12:47"),
        ("upload refused: PUT <path> quota", 3, "10:12:37", "10:12:44"),
        ("ledger sync stalled for 60s on node <ip>", 1, "10:12:46", "10:12:46"),
        ("shard map lost: no replica answers", 1, "10:12:41", "10:12:41"),
    ]
    assert r.top_errors[0].sample.endswith("10.0.0.5")


def test_sample_shares_and_texts(sample):
    report = commands.scan(sample, sources=["errors.log"], k=2)
    assert [tuple(x) for x in rep_out.report_csv(report).collect()] == [
        ("FATAL", 1, "6.67"), ("ERROR", 9, "60.00"), ("WARN", 3, "20.00"), ("INFO", 1, "6.67"), ("DEBUG", 1, "6.67")]
    assert rep_out.report_text(report).first().text.split("\n") == [
        "File:         errors.log",
        "Total lines:  15",
        "Time range:   2026-07-08 10:12:33 — 2026-07-08 10:12:47 (14s)",
        "",
        "Level  Count  %",
        "─────  ─────  ────",
        "ERROR  9      60.0%",
        "WARN   3      20.0%",
        "INFO   1      6.7%",
        "DEBUG  1      6.7%",
        "FATAL  1      6.7%",
        "",
        "Top errors:",
        " 1.  ledger sync stalled for 30s on node <ip>  5x  [10:12:33 - 10:12:47]",
        " 2.  upload refused: PUT <path> quota          3x  [10:12:37 - 10:12:44]",
    ]
    prompt = rep_out.prompt_text(report).first().prompt
    assert "Log source: errors.log\nTotal lines analyzed: 15\nTime range: 2026-07-08 10:12:33" in prompt
    assert prompt.endswith("2. [3x] upload refused: PUT <path> quota\n   Sample: upload refused: PUT /v2/parcels quota\n")
    body = json.loads(rep_out.report_json(report).first().json)
    assert list(body) == ["source", "total_lines", "time_range", "levels", "top_errors"]
    assert body["time_range"] == {"first": "2026-07-08T10:12:33Z", "last": "2026-07-08T10:12:47Z", "duration_sec": 14}


def test_empty_report(lines):
    report = commands.scan(lines([]))
    r = report.first()
    assert (r.total_lines, r.levels, r.top_errors, r.first_line) == (0, {}, [], None)
    assert rep_out.top_text(report).first().text == "No errors found."
    assert json.loads(rep_out.report_json(report).first().json) == {"source": "stdin", "total_lines": 0, "levels": {}}
    assert [x.pct for x in rep_out.report_csv(report).collect()] == ["0.00"] * 5


def test_top_modes(spark):
    df = events(spark, [(1, 2, "A"), (2, 2, "B"), (3, 3, "B"), (4, 0, "C")])
    for make in (lambda **o: [(g.signature, g["count"]) for g in agg.report(df, **o).first().top_errors],
                 lambda **o: [(g.signature, g["count"]) for g in agg.top_errors(df, **o).collect()]):
        assert make(k=1) == [("B", 2)]
        assert make(k=1, mode=agg.FIRST_K) == [("A", 1)]
        assert make(k=2, mode=agg.FIRST_K) == [("B", 2), ("A", 1)]
        assert make(k=0) == [("B", 2), ("A", 1)]
        assert make(k=-1) == []


def test_first_seen_is_the_first_arrival(spark):
    g = agg.report(events(spark, [(7200, 2, "x"), (3600, 2, "x")])).first().top_errors[0]
    assert (g.first_seen, g.last_seen) == (datetime.fromtimestamp(7200), datetime.fromtimestamp(7200))
    g = agg.report(events(spark, [(None, 2, "x"), (3600, 2, "x")])).first().top_errors[0]
    assert (g.first_seen, g.last_seen) == (None, datetime.fromtimestamp(3600))


def test_many_signatures_keep_exact_ranks(spark):
    rows = [(i, 2, "e" + "abcdefghijklmnopqrstuvwxyz"[i % 26] * (1 + i % 11)) for i in range(900)]
    want = {}
    for _, _, m in rows:
        want[m] = want.get(m, 0) + 1
    best = sorted(want.items(), key=lambda p: (-p[1], p[0]))[:20]
    for parts in (1, 16):
        top = agg.report(events(spark, rows).repartition(parts), k=20).first().top_errors
        assert [(g.signature, g["count"]) for g in top] == best


def test_unknown_levels_read_back_as_info(spark):
    doc = '{"source":"a","total_lines":3,"levels":{"ERROR":1,"LOUD":2},"first_line":"0001-01-01T00:00:00Z","last_line":"2026-07-08T10:12:47Z"}'
    r = rep_out.read_report(spark.createDataFrame([(doc,)], "json string")).first()
    assert (r.levels, r.top_errors, r.first_line) == ({"ERROR": 1, "INFO": 2}, [], None)


def test_filters(spark):
    df = events(spark, [(100, 0, "info"), (200, 2, "error timeout"), (None, 1, "no time"), (300, 3, "fatal")])
    keep = lambda f: sorted(r.message for r in f.apply(df).collect())
    at = datetime.fromtimestamp
    assert keep(flt.LogFilter(level=1)) == ["error timeout", "fatal", "no time"]
    assert keep(flt.LogFilter(since=at(200))) == ["error timeout", "fatal", "no time"]
    assert keep(flt.LogFilter(until=at(200))) == ["error timeout", "info", "no time"]
    assert keep(flt.LogFilter(pattern="time(out)?$")) == ["error timeout", "no time"]
    assert keep(flt.LogFilter(1, "e", at(150), at(250))) == ["error timeout", "no time"]
    assert keep(flt.LogFilter()) == keep(flt.LogFilter().at_least(-1))
    assert flt.LogFilter(level=3).at_least(2).level == 3


def test_pages(spark):
    df = events(spark, [(i, 0, f"m{i:03}") for i in range(130)])
    want = [f"m{i:03}" for i in range(130)]
    for offset, limit in ((0, 10), (5, 7), (120, 50), (130, 10), (500, 10), (63, 2)):
        rows = paging.page(df, offset, limit, bits=2).collect()
        assert [r.message for r in rows] == want[offset:offset + limit], (offset, limit)
    assert paging.page_bounds(-1, 0) == (0, 100) and paging.page_bounds(3, 1001) == (3, 100) and paging.page_bounds(0, 1000) == (0, 1000)
    assert [r.message for r in flt.search_messages(df, "M00", page_only=True, offset=5, limit=10).collect()] == want[5:10]
    assert {r.total for r in paging.page_with_total(df, 0, 5).collect()} == {130}


def test_limits_and_commands(sample):
    assert [paging.clamp_limit(n) for n in (0, -5, 5, 1000, 5000)] == [10, 10, 5, 1000, 1000]
    with pytest.raises(ValueError):
        commands.AnalyzeOptions("drop")
    assert [r.line for r in commands.errors(sample, n=3).collect()] == [1, 2, 4]
    assert [r.line for r in commands.grep(sample, "gc|spool", n=0).collect()] == [3, 7, 13]
    assert commands.top(sample).first().levels == {"ERROR": 9, "FATAL": 1}
    assert commands.analyze(sample, commands.AnalyzeOptions("errors", limit=1), "f").count() == 10
    assert commands.analyze(sample, commands.AnalyzeOptions("scan", level="warn"), "f").first().total_lines == 13


def test_progress_counters(sample):
    from pyspark.sql import Observation

    seen = Observation("p")
    import pyspark.sql.functions as F

    df = parse_events(sample).observe(seen, F.count("*").alias("parsed"), F.count_if(F.col("level") >= 2).alias("matched"))
    df.filter("level >= 2").collect()
    assert seen.get == {"parsed": 15, "matched": 10}
    assert agg.observe_progress(parse_events(sample), F.col("level") >= 2).count() == 15


def test_event_files(spark, lines, tmp_path):
    df = parse_events(lines([(0, "a", 1, '2026-07-08T10:12:33.500Z ERROR say "hi" <x>'), (0, "a", 2, "  two\n  lines ")]))
    ev_out.write_csv(ev_out.events_csv(df).coalesce(1), str(tmp_path / "c"))
    text = next(Path(tmp_path / "c").glob("*.csv")).read_text()
    assert text == 'timestamp,level,source,message\n2026-07-08T10:12:33.5Z,ERROR,a,"say ""hi"" <x>"\n,INFO,a,"two\n  lines"\n'
    ev_out.write_text(ev_out.events_json(df.filter("line = 1")).coalesce(1), str(tmp_path / "j"))
    assert next(Path(tmp_path / "j").glob("*.txt")).read_text() == (
        '{"timestamp":"2026-07-08T10:12:33.5Z","level":"ERROR","source":"a","message":"say \\"hi\\" \\u003cx\\u003e","line":1}\n')
    assert ev_out.event_text(df.filter("line = 1")).first().text == '2026-07-08 10:12:33 ERROR a:1 say "hi" <x>'


def test_all_groups_stand_beside_the_report(spark):
    df = events(spark, [(i, 2, f"alpha {'x' * (i % 40)} beta") for i in range(1000)] + [(1000, 0, "fine")])
    report, groups = agg.report_and_groups(df)
    (row,) = report.collect()
    assert row.total_lines == 1001 and row.top_errors == []
    ranked = groups.orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, 41))
    assert [tuple(r)[1:] for r in ranked] == [tuple(r) for r in agg.top_errors(df, 0).collect()]
    first = agg.ranked_groups(df, agg.FIRST_K).orderBy("rank").collect()
    assert [len(r.sample) for r in first] == sorted(len(r.sample) for r in first)
    assert agg.ranked_groups(df.filter("false")).count() == 0


def test_report_never_sorts_lines(spark, sample):
    """Below the first exchange of a report's aggregation there is no sort, and what is hashed has fixed-width buffers."""
    df = events(spark, [(i, i % 5 - 1, f"m{i} failed") for i in range(50)])
    plan = agg._tallies(df, None)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Sort [" not in plan
