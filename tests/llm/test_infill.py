import hashlib
import random
import re

from pyspark.sql import functions as F
from samples import words

from emberlog.llm import infill as I
from emberlog.llm import queries

DIR = "/root/testdata/sf0.001"


def by_hand(doc_id, text):
    """The contract, spelled out over whole strings."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(rows):
    for r in rows:
        n, form, p, m, out = by_hand(r.doc_id, r.text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m), r.doc_id
        assert r.output_sha256 == sha(out) and r.restored_sha256 == sha(r.text or "")


def made(docs, size):
    out = I.with_digests(I.infilled(I.framed(docs.withColumn("copy", F.col("text")), size), size))
    return out.select("_row.doc_id", F.col("_row.copy").alias("text"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()


def test_every_form_at_every_frame_size(docs):
    rng = random.Random(5)
    letters = ["a", "Z", "é", "日", "<", ">", "P", "S", "M", " ", "\n", "🎉", "<S", "M>", "ab" * 9, "\x00"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(i, t) for i in range(400, 440) for t in ("<P>", "x<M>y", "<S", "plain")]
    table = docs(rows)
    for size in (1, 2, 7, 50, I.FRAME_CHARS):
        found = made(table, size)
        assert len(found) == len(rows)
        check(found)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_a_cut_reads_one_frame_and_a_stream_all_in_order(monkeypatch):
    text = " ".join(words(i, 50) for i in range(100)) + "x" * 5000 + " end"
    frames = I.Frames.pack([text[:11], text[11:20_000], text[20_000:]], 1000)
    assert [r["first_char"] for r in frames.rows] == list(range(0, len(text), 1000)) and "".join(frames.stream()) == text
    units = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]
    assert frames.n_units == len(units) - 1
    opened, plain = [], I.Frames._plain
    monkeypatch.setattr(I.Frames, "_plain", lambda self, row: opened.append(row["first_char"]) or plain(self, row))
    for k in random.Random(1).sample(range(len(units)), 200) + [0, len(units) - 1]:
        opened.clear()
        assert frames.char_after(k) == units[k] and len(opened) <= 1
    opened.clear()
    assert "".join(frames.stream(2500, 4200)) == text[2500:4200] and opened == [2000, 3000, 4000]


def test_very_long_text(docs):
    text = words(1, 300_000) + "é" * 10 + "y" * 300_000
    check(made(docs([(i, text) for i in (0, 1, 3)]), I.FRAME_CHARS))


def test_odd_inputs(odd, none):
    found = made(odd.drop("copy"), 16)
    assert len(found) == odd.count()
    check(found)
    clash = odd.withColumns({c: F.lit("clash") for c in ("frames", "n", "form", "output", "prefix_chars", "_text")})
    out = I.with_digests(I.infilled(I.framed(clash)))
    assert out.count() == odd.count() and set(out.select("_row.*").columns) == set(clash.columns) - {"text"}
    assert made(none, 16) == []


def test_registered_query(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = queries.op13_infill(spark, DIR)
    assert out.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"),
                          ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
    rows = out.join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    check(rows)
