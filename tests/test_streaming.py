import gzip
import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from emberlog.operators.admission import admission
from emberlog.operators.filters import LogFilter
from emberlog.operators.fold import fold
from emberlog.sources.tail import tail_lines
from emberlog.streaming.admission import admission_stream
from emberlog.streaming.fold import fold_stream
from emberlog.streaming.watch import watch_events, watch_report

NOW = datetime(2026, 12, 31)


class Sink:
    """A query whose batches are gathered as rows."""

    def __init__(self, df, checkpoint, mode="append", **trigger):
        self.rows = []
        self.query = (
            df.writeStream.outputMode(mode).foreachBatch(lambda b, i: self.rows.extend(b.collect()))
            .option("checkpointLocation", str(checkpoint)).trigger(**(trigger or {"availableNow": True})).start()
        )

    def wait(self):
        assert self.query.awaitTermination(120)
        return self.rows

    def until(self, done, seconds=90):
        end = time.time() + seconds
        while not done(self.rows):
            assert time.time() < end and self.query.isActive, (self.rows, self.query.exception())
            time.sleep(0.2)
        return self.rows


def append(path, text):
    with open(path, "a") as f:
        f.write(text)


def keys(rows):
    return sorted((r.source.rsplit("/", 1)[-1], r.line, r.text) for r in rows)


def test_tail_follows_all_files_and_resumes(spark, tmp_path):
    a, b, z = (str(tmp_path / n) for n in ("a.log", "b.log", "z.log"))
    append(a, "one\r\ntwo\npart")
    append(b, "x\n")
    with gzip.open(z, "wt") as f:
        f.write("z1\nz2\nheld")
    df = tail_lines(spark, [a, b, z, str(tmp_path / "missing")], from_end=False)
    rows = Sink(df, tmp_path / "cp").wait()
    assert keys(rows) == [("a.log", 1, "one"), ("a.log", 2, "two"), ("b.log", 1, "x"), ("z.log", 1, "z1"), ("z.log", 2, "z2")]
    append(a, "ial\nnext\n")
    append(b, "y")
    assert keys(Sink(df, tmp_path / "cp").wait()) == [("a.log", 3, "partial"), ("a.log", 4, "next")]


def test_tail_from_the_end(spark, tmp_path):
    a = str(tmp_path / "a.log")
    append(a, "old\n")
    sink = Sink(tail_lines(spark, [a]), tmp_path / "cp", processingTime="200 milliseconds")
    try:
        time.sleep(8)
        append(a, "2026-07-08T10:12:33Z ERROR new\n")
        assert keys(sink.until(len)) == [("a.log", 1, "2026-07-08T10:12:33Z ERROR new")]
    finally:
        sink.query.stop()


def test_watch_events_and_report(spark, tmp_path):
    a = str(tmp_path / "a.log")
    append(a, "2026-07-08T10:12:33Z ERROR timeout 1\nINFO fine\n2026-07-08T10:12:35Z ERROR timeout 2\n")
    lines = tail_lines(spark, [a], from_end=False)
    rows = Sink(watch_events(lines, LogFilter(level=2), now=NOW), tmp_path / "c1").wait()
    assert sorted(r.message for r in rows) == ["timeout 1", "timeout 2"]

    reports = []

    def run():
        query = watch_report(
            watch_events(lines, now=NOW), lambda r, n: reports.append(r.first()), str(tmp_path / "c2"), sources=["a.log"])
        assert query.awaitTermination(120)

    run()
    append(a, "FATAL timeout 3\n")
    run()
    assert [r.total_lines for r in reports] == [3, 4]
    group = reports[-1].top_errors[0]
    assert (group.signature, group["count"], group.sample) == ("timeout <n>", 3, "timeout 1")


def test_ticks_hand_out_changed_groups_only(spark, tmp_path):
    a, reports, changes = tmp_path / "a.log", [], []
    lines = tail_lines(spark, [str(a)], from_end=False)

    def tick(text, **options):
        append(a, text)
        watch_report(
            watch_events(lines, now=NOW), lambda r, n: reports.append(r.first()), str(tmp_path / "cp"), sources=["a"], k=2,
            on_change=lambda g, n: changes.append({r.signature: r.n for r in g.filter("NOT whole").collect()}), **options
        ).awaitTermination(120)
        return [(g.signature, g["count"], g.sample) for g in reports[-1].top_errors]

    assert tick("ERROR a one\nERROR a one\nERROR b\nERROR c\nINFO x\n") == [("a one", 2, "a one"), ("b", 1, "b")]
    assert tick("ERROR c\nERROR c\n") == [("c", 3, "c"), ("a one", 2, "a one")]
    assert tick("INFO y\n") == [("c", 3, "c"), ("a one", 2, "a one")]
    assert tick("FATAL b\nERROR b\nERROR b\n") == [("b", 4, "b"), ("c", 3, "c")]
    assert changes == [{"a one": 2, "b": 1, "c": 1, None: 1}, {"c": 3}, {None: 2}, {"b": 4}]
    assert reports[-1].total_lines == 11 and reports[-1].levels == {"ERROR": 8, "FATAL": 1, "INFO": 2}


def test_fold_stream_equals_fold_over_blocks_and_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for source in range(3):
        for line in range(1, 400):
            if rng.random() < 0.95:
                indent = rng.random() < (0.97 if 100 < line < 250 else 0.6)
                rows.append((source, f"s{source}", line, None if rng.random() < 0.02 else (rng.choice(" \t") if indent else "") + f"t{line}"))
    schema = "source_ord int, source string, line bigint, text string"
    want = sorted((r.source, r.line, r.text) for r in fold(spark.createDataFrame(rows, schema), max_lines=4).collect())
    last = {s: max(line for name, line, _ in want if name == s) for s in ("s0", "s1", "s2")}
    path, out = str(tmp_path / "in"), []
    (tmp_path / "in").mkdir()
    stream = fold_stream(spark.readStream.schema(schema).parquet(path), 4, None, block_bits=4)
    for low, high in ((0, 37), (37, 38), (38, 210), (210, 400)):
        part = [r for r in rows if low <= r[2] < high]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(path)
        out += Sink(stream, tmp_path / "cp").wait()
    assert sorted((r.source, r.line, r.text) for r in out) == [w for w in want if w[1] < last[w[0]]]


def test_fold_holds_the_last_event(spark, tmp_path):
    a = str(tmp_path / "a.log")
    append(a, "head\n one\n two\n three\nnext\n")
    lines = tail_lines(spark, [a], from_end=False)
    sink = Sink(fold_stream(lines, max_lines=2, idle_ms=3000), tmp_path / "cp", processingTime="500 milliseconds")
    try:
        sink.until(lambda rows: len(rows) >= 2)
        assert keys(sink.rows)[:2] == [("a.log", 1, "head\n one\n two"), ("a.log", 4, " three")]
        sink.until(lambda rows: len(rows) >= 3)
        assert keys(sink.rows)[2] == ("a.log", 5, "next")
    finally:
        sink.query.stop()


def test_admission_over_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "key string, ts timestamp, event bigint"

    def add(rows):
        df = spark.createDataFrame(rows, "key string, at bigint, event bigint")
        df.select("key", F.timestamp_seconds("at").alias("ts"), "event").coalesce(1).write.mode("append").parquet(path)

    add([("a", 0, 1), ("b", 0, 2), ("a", 6, 3)])
    stream = admission_stream(
        spark.readStream.schema(schema).parquet(path), "key", "ts", 1, timedelta(seconds=10), ["event"])
    first = {r.event: r.admitted for r in Sink(stream, tmp_path / "cp", "update").wait()}
    add([("a", 12, 4), ("b", 9, 5)])
    second = {r.event: r.admitted for r in Sink(stream, tmp_path / "cp", "update").wait()}
    assert first == {1: True, 2: True, 3: False} and second == {4: True, 5: False}


def test_late_events_are_decided_in_order_and_idle_keys_end(spark, tmp_path):
    rng, path, rows = random.Random(8), str(tmp_path / "in"), []
    schema = "key string, ts timestamp, event bigint, name string"
    times = sorted(rng.randrange(3_000) for _ in range(400))
    events = [(f"k{rng.randrange(4)}" if t < 1_500 else "last", t, i, None if i % 9 == 0 else f"n{i}") for i, t in enumerate(times)]
    arriving = sorted(events, key=lambda e: e[1] + rng.random() * 99)
    (tmp_path / "in").mkdir()
    stream = admission_stream(
        spark.readStream.schema(schema).parquet(path), "key", "ts", 2, timedelta(seconds=60), ["event"], lateness=timedelta(seconds=100))
    for n in range(0, 400, 80):
        part = spark.createDataFrame(arriving[n : n + 80], "key string, at bigint, event bigint, name string")
        part.select("key", F.timestamp_seconds("at").alias("ts"), "event", "name").repartition(3).write.mode("append").parquet(path)
        sink = Sink(stream, tmp_path / "cp")
        rows += sink.wait()
    whole = spark.createDataFrame(events, "key string, at bigint, event bigint, name string")
    whole = whole.select("key", F.timestamp_seconds("at").alias("ts"), "event", "name")
    want = {r.event: r.admitted for r in admission(whole, "key", "ts", 2, timedelta(seconds=60), ["event"]).collect()}
    passed = max(t for _, t, _, _ in events) - 100
    assert {r.event: r.admitted for r in rows} == {e: want[e] for _, t, e, _ in events if t < passed}
    assert {(r.event, r.name) for r in rows} == {(e, name) for _, t, e, name in events if t < passed}
    held = sink.query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert 0 < held <= 4  # of five keys only the last one holds times, a frame and a timer


def test_many_late_keys_share_states_and_whole_numbers_stay_exact(spark, tmp_path):
    """More keys than groups, some events without a key, and numbers that no double can tell apart, some null."""
    path, big = str(tmp_path / "in"), 9007199254740993
    events = [(None if i % 10 == 0 else big + i % 1_500, 1 + i // 20, big + i, None if i % 7 == 0 else big - i) for i in range(6_000)]
    schema = "key bigint, at bigint, event bigint, n bigint"
    whole = spark.createDataFrame(events, schema).select("key", F.timestamp_seconds("at").alias("ts"), "event", "n").cache()
    for low, high in ((1, 200), (200, 301)):
        whole.filter(F.unix_timestamp("ts").between(low, high - 1)).repartition(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(path)
    decided = admission_stream(stream, "key", "ts", 2, timedelta(seconds=150), ["event"], lateness=timedelta(seconds=10), groups=8)
    assert decided.columns == [*whole.columns, "admitted"]
    sink = Sink(decided, tmp_path / "cp")
    rows = sink.wait()
    want = admission(whole, "key", "ts", 2, timedelta(seconds=150), ["event"]).filter(F.unix_timestamp("ts") < 290).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, want)) and len(want) == 5_780
    # Nine groups, each with its times, waiting frames and a timer.
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in sink.query.recentProgress) <= 9 * 4
