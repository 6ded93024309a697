import gzip
import os
import random

import pytest
from pyspark.sql import functions as F
from test_streaming import Sink, append, keys

from emberlog.sinks.logs import write_logs
from emberlog.sources import ranges as R
from emberlog.sources import tail as T
from emberlog.sources.tail import sized_for, tail_lines


def reader(paths, from_end=False, max_bytes=None, progress=None, range_bytes=10):
    return T._RangeStream([str(p) for p in paths], from_end, max_bytes, progress and str(progress), range_bytes)


def ranges(r, start, end):
    return [(os.path.basename(p.path), p.start, p.stop) for p in r.partitions(start, end)]


def test_the_driver_opens_no_file(tmp_path, monkeypatch):
    append(tmp_path / "a.log", "x" * 25)
    monkeypatch.setattr(R, "open_file", lambda path: pytest.fail("opened"))
    r = reader([tmp_path / "*.log"])
    start = r.initialOffset()
    assert list(start.values()) == [0]
    append(tmp_path / "a.log", "y" * 5)
    append(tmp_path / "b.log", "z")
    assert ranges(r, start, r.latestOffset()) == [("a.log", 0, 10), ("a.log", 10, 20), ("a.log", 20, 30), ("b.log", 0, 1)]


def test_budget_is_shared_fairly():
    assert T.fair_shares({"a": 5, "b": 100, "c": 100}, 45) == {"a": 5, "b": 20, "c": 20}
    assert T.fair_shares({"a": 1, "b": 2}, 50) == {"a": 1, "b": 2}
    assert T.fair_shares({"a": 9, "b": 9, "c": 9}, 1) == {"a": 1, "b": 1, "c": 1}
    assert T.fair_shares({}, 10) == {}


def test_files_start_grow_shrink_and_go(tmp_path):
    a, b, c = (tmp_path / n for n in ("a.log", "b.log", "c.log.gz"))
    append(a, "x" * 30)
    r = reader([tmp_path / "*.log", c], max_bytes=20)
    at = r.initialOffset()
    seen = []

    def step():
        nonlocal at
        end = r.latestOffset()
        seen.append(ranges(r, at, end))
        at = end

    step()
    append(b, "y" * 4)
    step()
    step()
    assert seen == [[("a.log", 0, 10), ("a.log", 10, 20)], [("a.log", 20, 30), ("b.log", 0, 4)], []]
    a.write_text("new")
    c.write_bytes(b"\x1f\x8b" + b"z" * 98)
    step()
    assert seen[-1] == [("a.log", 0, 3), ("c.log.gz", 0, 100)]
    a.write_text("")
    step()
    append(a, "w" * 7)
    b.unlink()
    step()
    append(b, "back again")
    step()
    assert seen[-3:] == [[], [("a.log", 0, 7)], [("b.log", 0, 10)]]


def test_budget_holds_after_a_restart(tmp_path):
    a = tmp_path / "a.log"
    append(a, "x" * 50)
    first = reader([a], max_bytes=20, progress=tmp_path / "progress")
    at = first.initialOffset()
    at = first.latestOffset()
    again = reader([a], max_bytes=20, progress=tmp_path / "progress")
    assert ranges(again, at, again.latestOffset()) == [("a.log", 20, 30), ("a.log", 30, 40)]
    unknown = reader([a], max_bytes=20)
    assert list(unknown.latestOffset().values()) == [50]


def lines_of(data: bytes):
    return [t.removesuffix(b"\r").decode("utf-8", "replace") for t in data.split(b"\n")[:-1]]


def test_lines_cut_by_ranges_and_batches(spark, tmp_path):
    """Files that grow by pieces of any length: the lines of a range of seven bytes are those that end in it."""
    rng = random.Random(4)
    makers = [b"", b"\r", b"x" * 40, "é日🎉".encode(), b"\xff\xfe", b" a b", b"q" * 700]
    whole = {n: b"".join(rng.choice(makers) + b"\n" for _ in range(60)) + b"open end" for n in ("a.log", "b.log")}
    with gzip.open(tmp_path / "c.log", "wb") as f:
        f.write(whole["a.log"])
    with gzip.open(tmp_path / "d.log", "wb") as f:
        f.write(b"m1\nm2 ")
    with gzip.open(tmp_path / "d.log", "ab") as f:
        f.write(b"goes on\nm3")
    df = tail_lines(spark, [f"{tmp_path}/*.log"], from_end=False, range_bytes=97)
    rows = []
    cuts = {n: sorted(rng.sample(range(len(d)), 2)) + [len(d)] for n, d in whole.items()}
    for step in range(3):
        for n, d in whole.items():
            (tmp_path / n).write_bytes(d[: cuts[n][step]])
        rows += Sink(df, tmp_path / "cp").wait()
    want = [(n, i, t) for n, d in [*whole.items(), ("c.log", whole["a.log"])] for i, t in enumerate(lines_of(d), 1)]
    want += [("d.log", 1, "m1"), ("d.log", 2, "m2 goes on")]
    assert keys(rows) == sorted(want)


def test_from_the_end_within_a_line_and_a_file_that_shrinks(spark, tmp_path):
    a = tmp_path / "a.log"
    append(a, "old\nhalf of a ")
    df = tail_lines(spark, [str(a), str(tmp_path / "late.log")], range_bytes=5)
    sink = Sink(df, tmp_path / "cp", processingTime="0 seconds")
    try:
        sink.query.processAllAvailable()
        append(a, "line\nsecond\n")
        append(tmp_path / "late.log", "from its beginning\n")
        sink.query.processAllAvailable()
        assert keys(sink.rows) == [("a.log", 1, "line"), ("a.log", 2, "second"), ("late.log", 1, "from its beginning")]
        a.write_text("anew\n")
        sink.query.processAllAvailable()
        assert keys(sink.rows)[0] == ("a.log", 1, "anew") and {r.source_ord for r in sink.rows} == {0, 1}
    finally:
        sink.query.stop()


def test_many_ranges_are_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(20_000)))
    tasks = []
    df = tail_lines(spark, [str(tmp_path / "a.log")], from_end=False, range_bytes=1 << 12)
    query = df.writeStream.foreachBatch(lambda b, i: tasks.append(b.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()))
    query = query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sum(tasks[0]) == 20_000 and max(tasks[0]) < 15_000 and len([n for n in tasks[0] if n]) > 2


def test_small_batches_keep_few_partitions_of_state(spark, tmp_path):
    append(tmp_path / "a.log", "one\ntwo\n")
    append(tmp_path / "b.log", "three\n")
    df = tail_lines(spark, [f"{tmp_path}/*.log"], from_end=False, max_bytes=50)
    with sized_for(spark, 50) as n:
        sink = Sink(df, tmp_path / "cp", processingTime="0 seconds")
    try:
        sink.query.processAllAvailable()
        state = [p["stateOperators"][0]["numShufflePartitions"] for p in sink.query.recentProgress]
    finally:
        sink.query.stop()
    assert n == 1 and set(state) == {1} and spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert keys(sink.rows) == [("a.log", 1, "one"), ("a.log", 2, "two"), ("b.log", 1, "three")]
    with sized_for(spark, 10 * R.RANGE_BYTES) as n:
        assert n == 4
    with sized_for(spark, 2 * R.RANGE_BYTES + 1) as n:
        assert n == 3


def test_a_source_is_written_by_one_task_after_a_join(spark, tmp_path):
    """A join by source with a small table: its shuffle must not be read by writer, which cut a source into tasks."""
    lines = spark.range(0, 40_000, 1, 8).selectExpr("concat('app-', id % 40, '.log') source", "id div 40 + 1 line", "concat('line ', id) text")
    half = spark.createDataFrame([(f"app-{i}.log", 500) for i in range(40)], "source string, half bigint")
    # As with tables of which it is not known before they are read that one is small, and lines that fill several tasks.
    settings = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "100k", "adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(f"spark.sql.{k}", v)
        wrote = write_logs(lines.join(half, "source").filter("line <= half"), str(tmp_path / "logs")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v) if v is not None else spark.conf.unset(f"spark.sql.{k}")
    assert sorted((r.source, r.lines) for r in wrote) == sorted((f"app-{i}.log", 500) for i in range(40))
    for i in range(40):
        found = (tmp_path / "logs" / f"app-{i}.log").read_text().splitlines()
        assert found == [f"line {40 * n + i}" for n in range(500)]


def test_many_small_ranges_share_a_task(spark, tmp_path):
    append(tmp_path / "a.log", "".join(f"line {i}\n" for i in range(3000)))
    append(tmp_path / "b.log", "x\n")
    r = reader([tmp_path / "*.log"], range_bytes=100)
    tasks = r.partitions(r.initialOffset(), r.latestOffset())
    each = [x for t in tasks for x in t.ranges]
    size = os.path.getsize(tmp_path / "a.log")
    assert len(tasks) == 1 and len(each) == -(-size // 100) + 1
    assert [(x.start, x.stop) for x in each[:2]] == [(0, 100), (100, 200)]
    counted = list(r.read(tasks[0]))
    assert len(counted) == len(each) and sum(c[-1] for c in counted) == 3001
    large = [T._Range(0, "a", i * R.RANGE_BYTES, (i + 1) * R.RANGE_BYTES) for i in range(T._FEW_RANGES + 6)]
    assert [t.ranges for t in T._in_tasks(large)] == [[x] for x in large]
    assert T._in_tasks(each[: T._FEW_RANGES]) == each[: T._FEW_RANGES]
    df = tail_lines(spark, [f"{tmp_path}/*.log"], from_end=False, range_bytes=100)
    rows = Sink(df, tmp_path / "cp").wait()
    assert keys(rows) == sorted([("a.log", i + 1, f"line {i}") for i in range(3000)] + [("b.log", 1, "x")])


def test_the_beginning_of_a_line_is_near_its_end_or_far(tmp_path, monkeypatch):
    monkeypatch.setattr(R, "_BACK_BYTES", 4)
    monkeypatch.setattr(R, "_PIECE_BYTES", 16)
    data = b"one\n" + b"x" * 200 + b"\nlast"
    (tmp_path / "a.log").write_bytes(data)
    path = str(tmp_path / "a.log")
    for at in range(1, len(data) + 1):
        for floor in (0, 2, 50):
            assert R.line_start(path, at, floor) == (at if at <= floor else max(floor, data.rfind(b"\n", 0, at) + 1))
