import gzip
from datetime import datetime

from pyspark.sql import functions as F

from emberlog.operators.filters import LogFilter
from emberlog.plans.commands import first_of_files
from emberlog.sources import files
from emberlog.sources.files import read_lines, resolve
from emberlog.sources.many import list_files, read_many
from emberlog.sources.lines import split_lines

NOW = datetime(2026, 12, 31)


def got(df):
    return sorted((r.source_ord, r.source.rsplit("/", 1)[-1], r.line, r.text) for r in df.collect())


def test_kinds_of_files(spark, tmp_path):
    (tmp_path / "a[1].log").write_bytes(b"one\r\ntwo\rx\n\nlast")
    (tmp_path / "b b.log").write_bytes(b"nul\0 byte\n")
    with gzip.open(tmp_path / "c.log.gz", "wt") as f:
        f.write("g1\ng2\n")
    with gzip.open(tmp_path / "d.log", "wb") as f:
        f.write(b"h1\r\nh2")
    (tmp_path / "e.gz").write_text("plain\n")
    (tmp_path / "f.log").write_text("")
    rows = got(read_lines(spark, [f"{tmp_path}/*", f"{tmp_path}/missing", f"{tmp_path}/e.gz", f"{tmp_path}/a[1].log"]))
    a = ["one", "two\rx", "", "last"]
    assert rows == (
        [(0, "a[1].log", i, t) for i, t in enumerate(a, 1)]
        + [(1, "c.log.gz", 1, "g1"), (1, "c.log.gz", 2, "g2"), (2, "d.log", 1, "h1"), (2, "d.log", 2, "h2")]
        + [(3, "e.gz", 1, "plain"), (5, "e.gz", 1, "plain")]
        + [(6, "a[1].log", i, t) for i, t in enumerate(a, 1)]
    )


def test_gzip_is_spread_after_unpacking(spark, tmp_path):
    body = "".join(f"{i} {'x' * (i % 200)}\r\n" for i in range(1, 60_001))
    for n in ("a.log.gz", "b.log"):
        with gzip.open(tmp_path / n, "wt", newline="") as f:
            f.write(body)
        with gzip.open(tmp_path / n, "at", newline="") as f:
            f.write("60001 " + "y" * 3_000_000 + "\n\n60003 end")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these shuffled files are tiny
    try:
        df = read_lines(spark, [f"{tmp_path}/a.log.gz", f"{tmp_path}/b.log"])
        found = df.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for source in (0, 1):
        mine = sorted((r.line, r.text) for r in found if r.source_ord == source)
        assert [line for line, _ in mine] == list(range(1, 60_004))
        assert all(t == f"{i} {'x' * (i % 200)}" for i, t in mine[:60_000])
        assert len(mine[60_000][1]) == 3_000_006 and mine[60_001][1] == "" and mine[60_002][1] == "60003 end"
    assert len({r.task for r in found}) > 1


def test_highly_compressed_lines_come_in_bounded_pieces(tmp_path):
    path = tmp_path / "z.gz"
    with gzip.open(path, "wb") as f:
        for _ in range(40):
            f.write(b"0" * 999_999 + b"\n")
    assert path.stat().st_size < 1 << 20
    assert max(map(len, files._pieces(f"file:{path}", True))) <= 1 << 20
    chunks = list(files._chunks(f"file:{path}", True))
    assert len(chunks) > 15 and sum(text.count("\n") + 1 for _, text in chunks) == 40


def test_arguments_in_order(spark, tmp_path):
    for n in "cab":
        (tmp_path / f"{n}.log").write_text(n)
    found = resolve(spark, [f"{tmp_path}/b.log", f"{tmp_path}/*.log", f"{tmp_path}/[x", f"{tmp_path}/{{a,b}}.log"])
    assert [f.source.rsplit("/", 1)[-1] for f in found] == ["b.log", "a.log", "b.log", "c.log"]
    assert read_lines(spark, [f"{tmp_path}/none"]).count() == 0


def test_line_numbers_over_many_splits(spark, tmp_path):
    big = [f"{i} {'x' * (i * 7919 % 211)}" for i in range(1, 12_001)]
    (tmp_path / "big.log").write_text("\n".join(big) + "\n")
    for n in range(20):
        (tmp_path / f"small{n:02}.log").write_text("1 a\n2 b\n")
    df = read_lines(spark, [f"{tmp_path}/*.log"])
    assert df.rdd.getNumPartitions() > 4
    rows = df.collect()
    assert len(rows) == 12_040
    assert all(r.text.split(" ")[0] == str(r.line) for r in rows)


def test_long_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("short\n" + "x" * 2_000_000 + "\nend\n")
    path = f"{tmp_path}/a.log"
    assert [len(r.text) for r in read_lines(spark, path).orderBy("line").collect()] == [5, 2_000_000, 3]
    flagged = read_lines(spark, path, max_line_bytes=1 << 20).orderBy("line").collect()
    assert [(r.line, len(r.text), r.too_long) for r in flagged] == [(1, 5, False), (2, 2_000_000, True), (3, 3, False)]


def test_lines_of_texts(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n"), (2, ""), (3, "\n"), (4, "x")], "id int, text string")
    assert sorted((r.id, r.line, r.text) for r in split_lines(df).collect()) == [(1, 1, "a"), (1, 2, "b"), (3, 1, ""), (4, 1, "x")]
    raw = sorted((r.id, r.line, r.text) for r in split_lines(df, raw=True).collect())
    assert raw == [(1, 1, "a\r"), (1, 2, "b"), (1, 3, ""), (2, 1, ""), (3, 1, ""), (3, 2, ""), (4, 1, "x")]


def test_the_first_events_read_a_few_ranges(spark, tmp_path):
    """Ten errors of 40 MB of files are found in the first 64 KB; more are sought in parts that grow."""
    for name in ("a.log", "b.log"):
        with open(tmp_path / name, "w") as f:
            for i in range(1, 400_001):
                f.write(f"{'ERROR' if i % 20 == 0 else 'INFO'} line {i} {'x' * 30}\n")
    paths, errors = [f"{tmp_path}/*.log"], LogFilter(level=2)
    options = {"first_bytes": 1 << 16, "range_bytes": 1 << 14}
    found, read = first_of_files(spark, paths, errors, 10, now=NOW, **options)
    assert [r.line for r in found.collect()] == list(range(20, 201, 20)) and read == 1 << 16
    found, read = first_of_files(spark, paths, errors, 25_000, now=NOW, first_bytes=1 << 21)
    rows = found.collect()
    assert [(r.source_ord, r.line) for r in rows] == [(0, i) for i in range(20, 400_001, 20)] + [(1, i) for i in range(20, 100_001, 20)]
    assert read == (1 << 21) * 21 or read == sum(f.stat().st_size for f in tmp_path.iterdir())


def test_first_events_of_odd_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"ERROR nul\0\n" * 100)
    with gzip.open(tmp_path / "b.log", "wb") as f:
        f.write(b"".join(b"ERROR packed %d\r\n" % i for i in range(5000)) + b"ERROR open end")
    (tmp_path / "c.log").write_text("")
    (tmp_path / "d.log").write_bytes(b"ERROR " + b"y" * 5000 + b"\nERROR last")
    paths = [f"{tmp_path}/*.log", f"{tmp_path}/none", f"{tmp_path}/d.log"]
    found, read = first_of_files(spark, paths, LogFilter(level=2), 6000, now=NOW, first_bytes=100, range_bytes=40)
    rows = [(r.source.rsplit("/", 1)[-1], r.line, len(r.raw)) for r in found.collect()]
    packed = [("b.log", i + 1, len(f"ERROR packed {i}")) for i in range(5000)] + [("b.log", 5001, 14)]
    assert rows == packed + [("d.log", 1, 5006), ("d.log", 2, 10)] * 2
    none, read = first_of_files(spark, [f"{tmp_path}/none"], n=3)
    assert none.count() == 0 and read == 0


def test_many_files_are_listed_and_read_by_tasks(spark, tmp_path):
    for d in range(6):
        (tmp_path / f"d{d}" / "logs").mkdir(parents=True)
        for n in range(20):
            (tmp_path / f"d{d}" / "logs" / f"f{n:02}.log").write_text(f"{d} {n} a\n{d} {n} b" + "\n" * (n % 2))
    (tmp_path / "d0" / "logs" / "f00.log").write_bytes(b"nul\0\n")
    (tmp_path / "d0" / "logs" / "sub.log").mkdir()
    with gzip.open(tmp_path / "d1" / "logs" / "f01.log", "wb") as f:
        f.write(b"packed\r\nend")
    patterns = [f"{tmp_path}/d3/logs/f07.log", f"{tmp_path}/d[^3]/logs/f0?.log", f"{tmp_path}/none", f"{tmp_path}/*/none/*", f"{tmp_path}/d3/*/*.log"]
    listed = [(r.arg, r.path) for r in list_files(spark, patterns).collect()]
    assert len(listed) == len(set(listed)) == 1 + 50 + 20 and {a for a, _ in listed} == {0, 1, 4}

    def dense(rows):
        place = {o: i for i, o in enumerate(sorted({r[0] for r in rows}))}
        return [(place[r[0]], *r[1:]) for r in rows]

    assert dense(got(read_many(spark, patterns, range_bytes=5))) == dense(got(read_lines(spark, patterns)))
    assert got(read_many(spark, f"{tmp_path}/nothing/*.log")) == []
