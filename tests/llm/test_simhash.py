import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from samples import words
from pyspark.sql import functions as F

from emberlog.llm import simhash as S
from emberlog.llm.common import components, shingles_of, words_of


def naive(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprint():
    for text in (None, "", " ", "a", "A b", "the cat\tsat on\nthe MAT", "É É É É é", words(1, 700)):
        assert int.from_bytes(S.fingerprint(text), "big") == naive(text), text


def classes(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_texts():
    rng = random.Random(5)
    out = []
    for base in range(12):
        w = words(base, 400).split()
        out.append(" ".join(w))
        for _ in range(base % 4):
            v = list(w)
            for _ in range(1 + base % 3):
                v[rng.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    return [*out, *out[:5], "", "only", "only"]


def test_radius_two_against_brute_force(spark, docs):
    texts = near_texts()
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs(list(enumerate(texts)))).collect()}
    fps = [naive(t) for t in texts]
    want = classes(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    assert [got[i] for i in range(len(texts))] == want


def test_jaccard_against_brute_force(spark, docs):
    texts = near_texts()
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs(list(enumerate(texts))), S.CORPUS).collect()}
    sets = [set(shingles_of(words_of(t), 5)) for t in texts]

    def alike(i, j):
        return len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert [got[i] for i in range(len(texts))] == classes(len(texts), alike)


def test_recall_at_the_threshold(spark, docs):
    """Two hundred pairs a little above 0.8: nearly all are found, and none of the pairs well below."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        w = words(1000 + i, 400).split()
        v = list(w)
        for at in rng.sample(range(0, 400, 5), 8 if i < 200 else 30):
            v[at] = f"new{at}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    sets = {i: set(shingles_of(words_of(t), 5)) for i, t in rows}
    true = {i for i in range(0, 800, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    assert len(true) > 150
    found = {r.doc_id - 1 for r in S.near_duplicates(docs(rows), S.CORPUS).filter("component_id <> doc_id").collect()}
    assert found <= true and len(found) >= 0.95 * len(true)


def test_crowded_cells_lose_nothing(spark):
    rng = np.random.default_rng(3)
    high = rng.choice(1 << 12, 1500, replace=False).astype(np.uint64) << np.uint64(50)
    rows = [(int(h | np.uint64(77)).to_bytes(8, "big"),) for h in high]
    sigs = spark.createDataFrame(rows, "sig binary")
    assert S.links_in_cells(S.cells(sigs, S.EXACT), S.EXACT).filter("b IS NULL").count() > 0
    got = {bytes(r.node): bytes(r.root) for r in components(S.linked(sigs, S.EXACT)).collect()}
    v = [int.from_bytes(r[0], "big") for r in sorted(rows)]
    x = np.array(v, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    root = classes(len(v), lambda i, j: near[i, j])
    want = {v[i].to_bytes(8, "big"): v[r].to_bytes(8, "big") for i, r in enumerate(root)}
    assert {k: got.get(k, k) for k in want} == want


def test_stars_link_everything_near():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, (3, 4), np.uint64)
    rows = np.repeat(base, 50, axis=0)
    for r in rows[1:]:
        r[rng.integers(4)] ^= np.uint64(1) << rng.integers(0, 64, dtype=np.uint64)
    stars, hung = S._Stars(20), 0
    for at in range(0, len(rows), 40):
        hung += sum(len(a) for a, _, _ in stars.add(rows[at:at + 40]))
    assert hung == len(rows) - 3 and len(stars.centres) == 3


def test_rows_hang_on_the_most_central():
    row, centre, degree = S._most_central(np.array([0, 1, 1, 4]), np.array([1, 2, 3, 5]), 7)
    assert dict(zip(row.tolist(), centre.tolist())) == {0: 1, 2: 1, 3: 1, 5: 4} and degree.tolist() == [3, 3, 3, 1]


def test_large_group_around_one_text(spark, docs):
    """Copies near one text but not near each other are one group; other texts stay."""
    rng = random.Random(8)
    base = words(1, 400).split()
    rows = []
    for n in range(600):
        v = list(base)
        for at in rng.sample(range(5, 395, 5), 8):
            v[at] = f"e{n}x{at}"
        rows.append((n, " ".join(v)))
    rows += [(600, " ".join(base))] + [(1000 + n, words(50 + n, 200)) for n in range(100)]
    kept = [r.doc_id for r in S.one_of_each_group(docs(rows).repartition(8)).collect()]
    assert sum(k <= 600 for k in kept) <= 12 and sum(k >= 1000 for k in kept) == 100


def test_odd_inputs(spark, odd, none):
    for plan in (S.EXACT, S.CORPUS):
        rows = S.near_duplicates(odd, plan).collect()
        assert len(rows) == odd.count()
        by = {(r.doc_id, bytes(r.text_key)): r for r in rows}
        of = {i: [r for (d, _), r in by.items() if d == i] for i in (1, 2, 3, 4, 7, 8, 9)}
        assert {of[i][0].component_id for i in (1, 2, 3)} == {1}
        assert of[8][0].component_id == of[7][0].component_id == 7
        assert of[9][0].component_id == 4  # upper case is no difference
        assert S.near_duplicates(none, plan).count() == 0
    kept = S.one_of_each_group(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 7 in ids and 8 not in ids and len(ids) == len({r.node_id for r in S.near_duplicates(odd, S.CORPUS).collect()})


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    assert components(edges).agg(F.max("root"), F.count("*")).first()[:] == (0, 201)


def template_group(seed, n, n_pairs):
    """Texts at about 0.72 to each other, of which some have one copy at about 0.87: ``rows, pairs``."""
    rng = random.Random(seed)
    base = words(seed, 400).split()

    def changed(w, at, name):
        v = list(w)
        for i in at:
            v[i] = f"{name}x{i}"
        return v
    rows, pairs = [], []
    for i in range(n):
        v = changed(base, rng.sample(range(5, 395, 6), 7), f"e{i}")
        rows.append(" ".join(v))
        if i < n_pairs:
            pairs.append((len(rows) - 1, len(rows)))
            rows.append(" ".join(changed(v, rng.sample(range(8, 395, 6), 6), f"c{i}")))
    return rows, pairs


def jaccard(a, b):
    x, y = set(shingles_of(words_of(a), 5)), set(shingles_of(words_of(b), 5))
    return len(x & y) / len(x | y)


def test_copies_inside_a_template_group(spark, docs):
    """A link to the group's centre that fails does not settle a row: its copy is still tried."""
    rows, pairs = template_group(21, 160, 60)
    assert all(jaccard(rows[a], rows[b]) >= 0.82 for a, b in pairs)
    assert np.median([jaccard(rows[0], r) for r in rows[2:]]) < 0.76
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs(list(enumerate(rows))), S.CORPUS).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    print("pairs found", found, "of", len(pairs))
    assert found >= 0.97 * len(pairs)
    want = classes(len(rows), lambda i, j: jaccard(rows[i], rows[j]) >= 0.8)
    assert sum(got[i] != want[i] for i in range(len(rows))) <= 0.03 * len(rows)


def test_repeated_phrases(spark, docs):
    """A phrase that is most of a text decides neither its fingerprint nor which texts it is compared with."""
    phrase, rows, pairs = words(77, 5), [], []
    for i in range(20):
        tail = words(7000 + i, 60)
        first = f"{phrase} " * 200 + tail
        second = (f"{phrase} " * (200 if i % 2 else 2)) + tail.rsplit(" ", 1)[0] + " other"
        pairs.append((len(rows), len(rows) + 1))
        rows += [first, second]
    assert all(jaccard(rows[a], rows[b]) >= 0.8 for a, b in pairs) and jaccard(rows[0], rows[2]) < 0.2
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs(list(enumerate(rows))), S.CORPUS).collect()}
    print("pairs found", sum(got[a] == got[b] for a, b in pairs), "of", len(pairs))
    assert [got[i] for i in range(len(rows))] == [i - i % 2 for i in range(len(rows))]


def test_recall_by_length(spark, docs):
    """Pairs at 0.8 or a little above, from texts of 8 words on: neither short nor long ones are lost."""
    rows, pairs, within = [], {}, []
    for n, new in ((8, 1), (12, 2), (16, 2), (20, 3), (40, 8), (120, 28)):
        for i in range(100):
            v = words(100_000 + 1000 * n + i, n)
            w = v + " " + " ".join(f"more{i}x{j}" for j in range(new))
            assert 0.8 <= jaccard(v, w) < 0.87
            pairs.setdefault(n, []).append((len(rows), len(rows) + 1))
            rows += [v, w]
            x, y = (int.from_bytes(S.fingerprint(t, S.CORPUS), "big") for t in (v, w))
            within.append((x ^ y).bit_count() <= S.CORPUS.radius)
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs(list(enumerate(rows))), S.CORPUS).collect()}
    found = {n: sum(got[a] == got[b] for a, b in some) for n, some in pairs.items()}
    print("within the radius", sum(within), "of", len(within), "found of 100 by words", found)
    assert sum(within) >= 0.998 * len(within)
    assert min(found.values()) >= 90
    assert len(set(got.values())) >= len(rows) // 2


def test_coordinates_discard_and_the_rest_is_verified():
    """Random and near fingerprints: no near pair is discarded, and of the others nearly all are."""
    rng = np.random.default_rng(11)
    words = rng.integers(0, 1 << 63, (500, 1), np.uint64) * np.uint64(2)
    for i in range(0, 500, 5):
        words[i + 1] = words[i] ^ np.uint64(1 << int(rng.integers(64)))
        words[i + 2] = words[i + 1] ^ np.uint64(1 << int(rng.integers(64)))
    table = S.pivot_table(words, S._full_pivots(8))
    first, second = np.triu_indices(500, 1)
    near = np.bitwise_count(words[first] ^ words[second]).sum(axis=1) <= 2
    kept = S.not_discarded(table, first, second, 2)
    assert not (near & ~kept).any() and near.sum() >= 300
    print("pairs", len(near), "near", near.sum(), "not discarded", kept.sum())
    assert (kept & ~near).sum() < 0.001 * len(near)
    x, y = S._near_in_cell(words, table, 2)
    assert {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())} == set(zip(first[near].tolist(), second[near].tolist()))


def test_blocks_grow_with_the_texts(spark, docs):
    assert S.plan_for(10_000_000) == S.CORPUS
    for texts, bits in ((10**8, 17), (10**9, 20), (10**11, 27)):
        plan = S.plan_for(texts)
        missed = [(1 - (1 - 39 / 256) ** p.block_bits) ** p.tables for p in (plan, S.CORPUS)]
        assert plan.block_bits == bits and texts / 2**bits <= S._TEXTS_A_CELL and missed[0] <= missed[1]
    base = words(1, 300).split()
    rows = [(i, " ".join(base[: 300 - i])) for i in range(10)] + [(i, words(i, 200)) for i in range(10, 40)]
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs(rows), S.plan_for(10**8)).collect()}
    assert got == {i: 0 if i < 10 else i for i in range(40)}


def greedy(words, radius):
    """Centres with the rows near them, the heaviest first, found anew among what is left every time."""
    left, out = list(range(len(words))), []
    while left:
        d = np.bitwise_count(words[left][:, None] ^ words[left][None, :]).sum(axis=2, dtype=np.int16)
        centre = int(np.where(d <= radius, radius + 1 - d, 0).sum(axis=1).argmax())
        mine = {left[i] for i in np.flatnonzero(d[centre] <= radius)}
        out.append((left[centre], sorted(mine - {left[centre]})))
        left = [i for i in left if i not in mine]
    return out


def crowd(groups, unlike, seed):
    """Fingerprints of 256 bits: groups of five that differ in some bits, and others at random; mixed."""
    rng = np.random.default_rng(seed)
    rows = [rng.bytes(32) for _ in range(unlike)]
    for _ in range(groups):
        base = np.frombuffer(rng.bytes(32), np.uint8)
        rows += [(base ^ np.packbits(rng.random(256) < 0.12)).tobytes() for _ in range(5)]
    return np.frombuffer(b"".join(rows[i] for i in rng.permutation(len(rows))), np.uint64).reshape(-1, 4)


def test_centres_of_a_cell_are_found_in_one_comparison(monkeypatch):
    """Rows that are near none used to be compared with all that were left, each in turn."""
    words = crowd(groups=20, unlike=300, seed=3)
    compared, plain = [], S._distances
    monkeypatch.setattr(S, "_distances", lambda x, y: compared.append(len(x) * len(y)) or plain(x, y))
    stars = S._Stars(72)
    got = [(a.tobytes(), b[0].tobytes(), n.tolist()) for a, b, n in stars.add(words) if len(a)]
    want = greedy(words, 72)
    assert sum(compared) <= len(words) ** 2
    assert got == [(words[m].tobytes(), words[c].tobytes(), [len(m)] * len(m)) for c, m in want if m]
    assert stars.centres.tolist() == [words[c].tolist() for c, _ in want]
    assert stars.degrees.tolist() == [len(m) for _, m in want]


def test_pairs_of_cells_side_by_side():
    words = np.concatenate([crowd(3, 5, seed) for seed in range(4)] + [crowd(2, 40, 9), crowd(0, 1, 10)])
    sizes = np.array([20, 20, 20, 20, 50, 1])
    starts = np.cumsum(sizes) - sizes
    x, y = S._near_in_cells(words, starts, sizes, 72)
    d = np.bitwise_count(words[:, None] ^ words[None, :]).sum(axis=2, dtype=np.int16)
    cell = np.repeat(np.arange(len(sizes)), sizes)
    want = {(i, j) for i in range(len(words)) for j in range(i) if cell[i] == cell[j] and d[i, j] <= 72}
    pairs = list(zip(y.tolist(), x.tolist()))
    assert set(pairs) == want and len(pairs) == len(want) >= 100


def test_shingle_sets_are_kept_up_to_a_number_of_shingles(monkeypatch):
    monkeypatch.setattr(S, "_KEPT", 1000)
    sets = S._ShingleSets(5)
    texts = [words(i, 300) for i in range(20)]
    for i in [0, 1, 0, 2, *range(20), 0]:
        assert sets.of(b"%d" % i, pa.scalar(texts[i])) == set(shingles_of(words_of(texts[i]), 5))
        assert sum(map(len, sets.sets.values())) == sets.size <= 1000
    assert S._jaccard(frozenset(), frozenset()) == 1.0 and S._jaccard(frozenset("ab"), frozenset("bc")) == 1 / 3
