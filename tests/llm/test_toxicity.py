import zlib

import numpy as np
from samples import CLASHES, words

from pyspark.sql import functions as F

from emberlog.llm import queries
from emberlog.llm import toxicity as T

DIR = "/root/testdata/sf0.01"


def _corpus(docs, spark, n=600):
    """Invented texts of 5 to 400 words; every eighth has one of six insults in some form, a half of the rows is labelled."""
    rows, labels = [], []
    for i in range(n):
        text = words(i, 5 + (i * 37) % 395).split()
        if i % 8 == 0:
            text.insert(len(text) // 2, ["grobnik", "Grobnikan", "vexilump", "vexilumper", "SNARDO", "snardolin"][i // 8 % 6])
        rows.append((i, " ".join(text)))
        if zlib.crc32(f"label {i}".encode()) % 3:
            labels.append((i, int(i % 8 == 0), 1))
    return docs(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")


def test_finds_toxic_texts_of_any_length_and_leaves_clean_ones(spark, docs):
    texts, labels = _corpus(docs, spark)
    model = T.fit(texts, labels)
    found = {r.doc_id: r for r in T.with_scores(texts, model).select("_row.doc_id", "score", "predicted").collect()}
    held = [r for i, r in found.items() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(found) == 600 and len(held) > 100
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= T.THRESHOLD) for r in found.values())
    assert np.mean([r.predicted == (r.doc_id % 8 == 0) for r in held]) >= 0.97
    long = words(1001, 500)
    assert model.score(long) < T.THRESHOLD <= model.score(long + " grobnik " + long)


def test_training_is_the_non_negative_risk():
    """Against a plain loop over the same rule on few buckets."""
    rng = np.random.default_rng(3)
    toxic = [np.unique(np.append(rng.integers(0, 12, 3), 12)) for _ in range(20)]
    plain = [np.unique(rng.integers(0, 12, 3)) for _ in range(60)] + toxic[:6]
    theta = T.train(toxic, plain, 0.1, size=16)
    assert theta[12] == max(theta[:-1]) and theta[12] > 1 and (theta[:-1] >= 0).all()

    size, prior = 16, 0.1
    want, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    want[-1] = np.log(prior / (1 - prior))
    rows = [[np.bincount(r, minlength=size) for r in some] for some in (toxic, plain)]
    keep = np.sum(rows[0], axis=0) >= 3
    p, u = (np.array([np.append(r * keep, 1) for r in some]) for some in rows)
    for step in range(1, T._ROUNDS + 1):
        sp, su = 1 / (1 + np.exp(-p @ want)), 1 / (1 + np.exp(-u @ want))
        risk = -np.log(1 - su).mean() + prior * np.log(1 - sp).mean()
        clean = (u * su[:, None]).mean(0) - prior * (p * sp[:, None]).mean(0)
        slope = clean - prior * (p * (1 - sp)[:, None]).mean(0) if risk >= 0 else -clean
        slope[:-1] += T._DECAY
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        want -= T._RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        want[:-1] = np.maximum(want[:-1], 0)
    assert np.allclose(theta, want, atol=1e-6)


def test_scores_see_only_the_text_and_learning_no_held_out_label(spark, docs):
    texts, labels = _corpus(docs, spark, 300)
    model = T.fit(texts, labels)
    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = T.fit(texts, flipped)
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias
    other = texts.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "doc_id": F.col("doc_id") + 7})
    scores = [{r.text: r.score for r in T.with_scores(t, model).select("_row.text", "score").collect()} for t in (texts, other)]
    assert scores[0] == scores[1]


def test_registered_query(spark):
    out = queries.op11_toxicity(spark, DIR)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = out.collect()
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = ([r.score for r in held if labels[r.doc_id] == k] for k in (1, 0))
    assert np.mean([t > c for t in toxic for c in clean]) >= 0.9


def test_odd_inputs(spark, docs, odd, none):
    texts, labels = _corpus(docs, spark, 200)
    clash = labels.withColumns({c: F.lit("clash") for c in ("text", "buckets", "part", "classifier", "score")})
    more = clash.unionByName(clash).unionByName(clash.limit(1).withColumns({"doc_id": F.lit(None), "toxic": F.lit(1)}))
    a = T.fit(texts.unionByName(texts).withColumns({c: F.lit("x") for c in CLASHES}), more.unionByName(clash.limit(1).withColumn("toxic", F.lit(None))))
    b = T.fit(texts, labels)
    assert np.array_equal(a.weights, b.weights)
    out = T.with_scores(odd, a)
    assert out.count() == odd.count() and out.select("_row.*").columns == odd.columns
    empty = {r.score for r in out.filter("coalesce(trim(_row.text), '') = ''").collect()}
    assert len(empty) == 1 and 0 < empty.pop() < T.THRESHOLD
    assert T.with_scores(none, a).count() == 0
    nobody = T.fit(none, labels)
    assert {r.score for r in T.with_scores(odd, nobody).collect()} == {0.0}
    assert T.fit(texts, labels.filter("toxic = 0")).score("grobnik") == 0.0
