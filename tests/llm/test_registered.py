"""Queries without SQL, as registered, against plain Python over the smallest tables, column types included."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from test_minhash import by_hand as minhash_by_hand
from test_mixing import targets
from test_secrets import naive

from emberlog.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    return {r.doc_id: r for r in rows}


def run(spark, name, types):
    out = QUERIES[name](spark, DIR)
    found = dict(out.dtypes)
    assert {c: found.get(c) for c in types} == types
    return out.collect()


def test_op1_simhash(spark, table):
    got = {r.doc_id: r for r in run(spark, "op1_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})}
    prints = {}
    for doc, row in table.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (row.text or "").encode().lower())
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {d: d for d in table}
    for a in sorted(table):
        for b in sorted(table):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {d: x if r == y else r for d, r in root.items()}
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{prints[d]:016x}", root[d]) for d in table}


def test_op2_mix(spark, table):
    rows = run(spark, "op2_mix", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"})
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in table.items()}
    sums = {}
    for d, r in table.items():
        sums[r.source] = sums.get(r.source, 0) + size[d]
    want = targets(sums)
    assert {r.doc_id: (r.size, r.source_size) for r in rows} == {d: (size[d], sums[t.source]) for d, t in table.items()}
    assert all(r.target == pytest.approx(want[table[r.doc_id].source]) and 0 <= r.taken <= 2 * r.size for r in rows)
    for source, target in want.items():
        mine = [r for r in rows if table[r.doc_id].source == source]
        assert abs(sum(r.taken for r in mine) - target) <= max(r.size for r in mine)
    again = run(spark, "op2_mix", {})
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_op3_language(spark, table):
    rows = run(spark, "op3_language", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    assert {r.doc_id: r.held_out for r in rows} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in table}
    learned = {t.lang for d, t in table.items() if t.lang is not None and zlib.crc32(str(d).encode()) % 5}
    assert all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        has_letter = any(c.isalpha() for c in table[r.doc_id].text or "")
        assert (r.lang_pred in learned) if has_letter else r.lang_pred == "und"
    assert np.mean([r.lang_pred == table[r.doc_id].lang for r in rows if r.held_out and table[r.doc_id].lang]) >= 0.9


def test_op5_secrets(spark, table):
    types = {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}
    for r in run(spark, "op5_secrets", types):
        base = naive(table[r.doc_id].text)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, k, _ in base) for kind in ("assign", "access", "hex")]
        joined = [f"{k}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("dense:")] == joined
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_op8_token_count(spark, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    for r in run(spark, "op8_token_count", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}):
        text = table[r.doc_id].text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)


def test_op9_minhash(spark, table):
    types = {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string",
             "near_edited": "double", "near_next": "double"}
    rows = [tuple(r[c] for c in types) for r in run(spark, "op9_minhash", types)]
    assert sorted(rows, key=str) == minhash_by_hand([(d, r.text) for d, r in table.items()])
