import re

import pytest
from samples import words
from pyspark.sql import functions as F

from emberlog.llm import mixing as M


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Dealt out again and again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in list(open_):
            got[s] += left * w[s] / total
        left = 0.0
        for s in list(open_):
            if got[s] > most * sizes[s]:
                left += got[s] - most * sizes[s]
                got[s] = most * sizes[s]
                open_.discard(s)
    return got


def rows_of(n=900, sources=5):
    return [(i, words(i, 1 + (i * 37) % 90), "en", None if i % 11 == 0 else f"s{(i * i) % sources}") for i in range(n)]


def test_targets(spark):
    sizes = {"b": 100, "a": 1000, None: 40, "é": 3, "c": 0, "Z": 700}
    df = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r.source: r.target for r in M.source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


@pytest.mark.parametrize("importance", [None, "sqrt(size)", "1.0D / size"])
def test_taken_meets_targets(spark, docs, importance):
    rows = rows_of()
    importance = F.expr(importance) if importance else None
    out = M.mix(docs(rows), importance).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text))
    want = targets(sizes)
    for source in sizes:
        mine = [r for r in out if r.source == source]
        assert mine[0].target == pytest.approx(want[source]) and mine[0].source_size == sizes[source]
        assert abs(sum(r.taken for r in mine) - want[source]) <= max(r.size for r in mine)
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in out)
    assert sorted(map(tuple, M.mix(docs(rows), importance).collect()), key=str) == sorted(map(tuple, out), key=str)


def test_importance_tilts_the_draw(spark, docs):
    rows = [(i, words(i, 20 if i % 2 else 40), "en", f"s{i % 3 == 0}") for i in range(3000)]
    out = M.mix(docs(rows), F.col("size").cast("double"), weights=(1.0,), share=0.6, most=2).collect()
    mean = {n: sum(r.copies for r in out if r.size == n) / sum(r.size == n for r in out) for n in (20, 40)}
    assert mean[40] == pytest.approx(2 * mean[20], rel=0.15)  # expected in proportion to importance


def test_a_hot_source_is_never_shuffled_by_its_name(spark, docs):
    """Nine rows in ten of one source: no exchange by source alone hands a task more than one row per source, task and bin."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, words(i, 1 + i % 40), "en", "hot" if i % 10 else f"s{i % 7}") for i in range(4000)]
        out = M.mix(docs(rows), F.sqrt("size"))
        taken = {r.source: r.n for r in out.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
        target = {r.source: r.target for r in out.select("source", "target").distinct().collect()}
        assert all(abs(taken[s] - target[s]) <= 40 for s in target)
        plan = out._jdf.queryExecution().executedPlan().toString()
        by_source = re.findall(r"Exchange hashpartitioning\(_s#\d+, \d+\).*", plan)
        # The only join by source is the one with the last document, which names the document as well.
        assert not re.search(r"SortMergeJoin \[_s#\d+\], \[_s#\d+\]", plan), by_source
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_odd_inputs(spark, odd, none):
    out = M.mix(odd).collect()
    assert len(out) == odd.count() and all(r.taken <= 2 * r.size for r in out)
    assert abs(sum(r.taken for r in out) - 1.5 * sum(r.size for r in out)) <= 3000
    assert M.mix(none).count() == 0 and M.mixed_documents(none).count() == 0
    mixed = M.mixed_documents(odd)
    assert {"doc_id", "text", "lang", "source", "n_chars", "copies", "taken"} <= set(mixed.columns)
    assert sorted(r.taken for r in mixed.collect()) == sorted(r.taken for r in out if r.taken or r.copies)
