import hashlib
import random

import numpy as np
import pytest
from samples import words

from emberlog.llm import minhash as M
from emberlog.llm.common import shingles_of, words_of


def test_hashes_tell_shingles_apart():
    text = words(1, 4000)
    shingles = shingles_of(words_of(text), 5)
    hashes = M.shingle_hashes(text)
    assert len(hashes) == len(shingles) and len(set(hashes.tolist())) == len(set(shingles))
    again = dict(zip(shingles_of(words_of("extra words up front " + text), 5), M.shingle_hashes("extra words up front " + text).tolist()))
    assert all(again[s] == h for s, h in zip(shingles, hashes.tolist()))
    assert len(M.shingle_hashes("one two")) == 1 and len(M.shingle_hashes(" \n")) == 0


def test_likeness_estimates_jaccard():
    rng = random.Random(2)
    errors = []
    for i in range(60):
        w = words(i, 300).split()
        v = [x if rng.random() > i / 200 else "new" for x in w]
        a, b = " ".join(w), " ".join(v)
        x, y = set(shingles_of(words_of(a), 5)), set(shingles_of(words_of(b), 5))
        errors.append(M.likeness(M.signature(a), M.signature(b)) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


@pytest.mark.parametrize("chunks", [1, 3, 50])
def test_edited_texts(spark, docs, chunks):
    rows = [(i * 3, rng_text) for i, rng_text in enumerate([words(i, i * 7 % 60) for i in range(40)])]
    rows += [(1000, None), (1001, ""), (1002, "é🎉 ab"), (-5, "last of all"), (None, "b without id"), (None, "a without id"), (60, "b tie"), (60, "a tie")]
    want = by_hand(rows)
    got = [tuple(r) for r in M.compare_with_next(docs(rows), chunks=chunks).collect()]
    assert sorted(got, key=str) == want


def by_hand(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).digest()))
    want = []
    for i, (doc, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        sig = M.signature(text)
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), sig.astype(">u2").tobytes().hex(),
                     M.signature(edited).astype(">u2").tobytes().hex(), M.likeness(sig, M.signature(edited)), M.likeness(sig, M.signature(following))))
    return sorted(want, key=str)


def test_one_id_and_one_text_that_fill_chunks(spark, docs):
    """A third of the rows have one id, a third have none, and half of either are one text."""
    rows = [(i, words(i, 5)) for i in range(300)]
    rows += [(150, "the same text" if i % 2 else words(i, 6)) for i in range(300)]
    rows += [(None, "nameless" if i % 2 else words(i, 7)) for i in range(300)]
    random.Random(1).shuffle(rows)
    table = docs(rows)
    got = M.compare_with_next(table, chunks=30)
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows)
    sizes = [n for n in got.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert sum(sizes) == 900 and max(sizes) <= 100 and len(sizes) >= 25


def test_similar_texts_against_brute_force(spark, docs):
    rng = random.Random(4)
    texts = []
    for i in range(40):
        w = words(i, 500).split()
        texts.append(" ".join(w))
        for _ in range(i % 3):
            v = list(w)
            for at in rng.sample(range(0, 500, 5), 4):
                v[at] = "new"
            texts.append(" ".join(v))
    texts += texts[:6] + ["", None]
    got = {r.doc_id: r.class_id for r in M.similar_texts(docs(list(enumerate(texts)))).collect()}
    sets = [set(shingles_of(words_of(t), 5)) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert [got[i] for i in range(len(texts))] == label


def test_odd_inputs(spark, odd, none):
    assert M.compare_with_next(odd).count() == odd.count() and M.compare_with_next(none).count() == 0
    assert M.similar_texts(odd).count() == odd.count() and M.similar_texts(none).count() == 0
    assert M.compare_with_next(odd.filter("doc_id = 7")).first().near_next == 1.0  # its own next


def test_pairs_inside_a_boilerplate_group(spark, docs):
    """Texts of twelve of sixteen paragraphs, each with one copy at 0.8 or more: no head of a bucket hides the copy."""
    rng = random.Random(6)
    pool, chosen, texts = [words(300 + i, 25).split() for i in range(16)], [], []
    for _ in range(4000):
        some = set(rng.sample(range(16), 12))
        if all(len(some & c) <= 10 for c in chosen):
            chosen.append(some)
    for i, some in enumerate(chosen):
        v = [w for p in sorted(some) for w in pool[p]]
        texts.append(" ".join(v))
        for at in rng.sample(range(5, 295, 6), 4):
            v[at] = f"c{i}x{at}"
        texts.append(" ".join(v))
    n = len(chosen)
    sets = [set(shingles_of(words_of(t), 5)) for t in texts]
    alike = [(i, j) for i in range(2 * n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert alike == [(2 * i + 1, 2 * i) for i in range(n)]
    got = {r.doc_id: r.class_id for r in M.similar_texts(docs(list(enumerate(texts)))).collect()}
    print("pairs found", sum(got[i] == got[j] for i, j in alike), "of", n)
    assert [got[i] for i in range(2 * n)] == [i - i % 2 for i in range(2 * n)]
