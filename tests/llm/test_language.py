import zlib

from pyspark.sql import functions as F

from emberlog.llm import language as L

DIR = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.identify(docs, L.fit(docs)).select(
        "_row.doc_id", "_row.lang", "lang_pred", "score", L.held_out(F.col("_row.doc_id")).alias("held")).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_prediction_sees_only_text(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = L.fit(docs)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "doc_id": F.col("doc_id") + 1000})
    a = {r.text: r.lang_pred for r in L.identify(docs, model).select("_row.text", "lang_pred").collect()}
    b = {r.text: r.lang_pred for r in L.identify(other, model).select("_row.text", "lang_pred").collect()}
    assert a == b


def test_rejection(spark, docs):
    model = L.fit(spark.read.parquet(f"{DIR}/documents.parquet"))
    langs, scores, rejected = model.predict([None, "", "123 !!", "Ελληνικά είναι μια γλώσσα που δεν μάθαμε ποτέ εδώ", "zqxj " * 200, "the"])
    assert langs[:3] == ["und"] * 3 and scores[:3] == [0.0] * 3 and rejected[:5] == [True] * 5
    assert langs[5] != "und"


def test_odd_inputs(spark, odd, none):
    model = L.fit(spark.read.parquet(f"{DIR}/documents.parquet"))
    out = L.identify(odd, model)
    assert out.count() == odd.count() and out.select("_row.*").columns == odd.columns
    assert L.fit(none).languages == () and L.fit(odd).languages == ()
    assert L.identify(odd, L.fit(none)).filter("lang_pred <> 'und' OR NOT rejected").count() == 0
    assert L.identify(none, model).count() == 0
