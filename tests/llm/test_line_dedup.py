import random

import pytest

from emberlog.llm import line_dedup as D

SPACE = " \t\n\v\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows):
    order = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                order.setdefault(key(line), set()).add((doc is None, doc or 0))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(order[key(x)]) < 2 or min(order[key(x)]) == (doc is None, doc or 0)]
        out.append((doc, "\n".join(kept), len(lines) - len(kept)))
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    pool = [f"line number {i} of the pool" for i in range(30)] + ["short", "", "éééééééééé", "ééééééééé", "日本語の行ですよねえ、はい"]
    rows = []
    for i in range(150):
        lines = [rng.choice([str.upper, str, lambda x: f" \t{x}\v "])(rng.choice(pool)) for _ in range(rng.randrange(6))]
        lines += ["the line that a third of all rows hold"] * rng.choice([0, 0, 3]) + [f"own line of {i} here"] * rng.randrange(3)
        rng.shuffle(lines)
        rows.append((rng.choice([i, i, i, i - 1, None]) if i else 0, rng.choice(["\n".join(lines)] * 9 + [None])))
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("partitions", ["1", "4", "60"])
def test_against_brute_force(spark, docs, seed, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = case(seed)
        got = [(r._row.doc_id, D.kept_text(r._row.text, r.bitmap), r.n_dropped or 0) for r in D.with_bitmaps(docs(rows), D.line_bitmaps(docs(rows))).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got, key=str) == brute(rows)


def test_many_ranges_cut_a_hot_line(spark, docs):
    """One line in every document, over more tasks than there are other lines."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, "the same long line\nand own line %d\nthe same long line" % i) for i in range(400)]
        got = {r.doc_id: D.dropped_positions(r.bitmap).tolist() for r in D.line_bitmaps(docs(rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: [0, 2] for i in range(1, 400)}


def test_odd_inputs(spark, odd, none):
    kept = D.without_repeated_lines(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    texts = [(r.doc_id, r.text, r.n_chars) for r in kept.collect()]
    assert (8, "", 0) in texts and (1, None, None) in texts and texts.count((None, "no id at all here", 17)) == 2
    assert D.line_bitmaps(none).count() == 0 and D.without_repeated_lines(none).count() == 0


def test_two_marks_per_task(spark, docs):
    """Marks follow the tasks, however many Arrow batches a task reads."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "10")
    try:
        rows = [(i, f"line number {i} of many\nline number {i // 2} of few") for i in range(1500)]
        order = ["hi", "lo", "last", "doc_id", "text_key", "pos"]
        lines = D._line_rows(docs(rows), 10).repartitionByRange(4, *order).sortWithinPartitions(*order)
        marks = D._streamed(lines).filter("kind = 2").count()
        got = [(r._row.doc_id, D.kept_text(r._row.text, r.bitmap), r.n_dropped or 0) for r in D.with_bitmaps(docs(rows), D.line_bitmaps(docs(rows))).collect()]
    finally:
        spark.conf.set(size, before)
    print("marks", marks)
    assert sorted(got, key=str) == brute(rows) and marks <= 8
