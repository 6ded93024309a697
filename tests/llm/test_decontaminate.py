import random
import re
import time

import pytest
from pyspark.sql import functions as F
from samples import words

from emberlog.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        m = min(len(w), 10)
        for i in range(len(w) - m + 1) if w else ():
            windows.setdefault(tuple(w[i:i + m]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for m in {len(k) for k in windows}:
            for i in range(len(w) - m + 1):
                if names := windows.get(tuple(w[i:i + m])):
                    hit |= set(range(i, i + m))
                    found |= names
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def case(seed, short):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 20 + ["Été", "ß"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([10, 11, 25, 60] + ([1, 3, 9] if short else []))))) for i in range(12)]
    items += [(3, "an item with the same id but quite another text than the first of them"), (None, "no id but a text of ten words or even more than that"), (99, None), (98, " .. ")]
    docs = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            part = split(rng.choice(items)[1])
            a = rng.randrange(len(part) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in part[a:a + rng.randrange(8, 30)]]
        docs.append((i, rng.choice([" ", ", ", "\n- "]).join(w)))
    docs += [(100, "the " * 300), (101, None), (102, ""), (103, items[0][1]), (103, items[0][1]), (None, items[1][1])]
    return docs, items


@pytest.mark.parametrize("seed, short", [(1, False), (2, True), (3, True)])
@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_against_brute_force(spark, docs, monkeypatch, seed, short, limit):
    monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
    rows, items = case(seed, short)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.passages(docs(rows), table).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == brute(rows, items)
    assert all(sum(s.end - s.first for s in r.spans) == r.n_hit for r in got)


def test_every_long_span_is_found(spark, docs):
    """A shared run of ten words anywhere, also where all grams tie."""
    item = " ".join(f"x{i % 7}" for i in range(50))
    rows = [(i, " ".join([f"a{i}"] * (i % 9) + item.split()[i:i + 10] + ["z"] * (i % 5))) for i in range(40)]
    got = D.passages(docs(rows), spark.createDataFrame([(1, item)], "item_id bigint, text string")).filter("n_hit < 10")
    assert got.count() == 0


def test_odd_inputs(spark, odd, none):
    items = spark.createDataFrame([(1, "another text of id four"), (2, "x" * 30_000)], "item_id int, text string")
    out = {(r.doc_id, r.n_words): r for r in D.passages(odd, items).collect()}
    assert out[4, 5].n_hit == 5 and out[12, 1]["items"] == ["2"] and out[1, 0].n_hit == 0
    assert D.passages(odd, items).count() == odd.count()
    assert D.passages(none, items).count() == 0
    assert D.passages(odd, items.limit(0)).filter("n_hit > 0").count() == 0
    clean = D.clean_documents(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 2
    assert D.clean_documents(odd.select(F.expr("*")), items.limit(0)).count() == odd.count()


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_a_very_long_text(spark, docs, monkeypatch, limit):
    """200,000 words with a thousand passages of an item, and one copied whole."""
    monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
    item = words(1, 300).split()
    own = words(2, 100_000).split()
    parts = [own[i * 100 : i * 100 + 100] + item[i % 200 : i % 200 + 12 + i % 9] for i in range(1000)]
    text = " ".join(w for p in parts for w in p) + " " + " ".join(words(3, 80_000).split())
    items = spark.createDataFrame([(1, " ".join(item)), (2, words(3, 80_000)), (3, " ".join(item[:4]))], "item_id bigint, text string")
    start = time.time()
    (row,) = D.passages(docs([(7, text)]), items).collect()
    assert time.time() - start < 60
    assert row.n_words == len(text.split()) and list(row["items"]) == ["1", "2", "3"]
    assert row.n_hit == sum(len(p) - 100 for p in parts) + 80_000 and len(row.spans) >= 1000
