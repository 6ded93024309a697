import hashlib
import math
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from emberlog.llm import prefix_trie as P
from emberlog.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import connect  # noqa: E402

DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_hand(rows):
    """The contract over dicts of whole prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, key), role, text))
    turns = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    built = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[c] for c in below) or 1
        saved[node] = sum(saved[c] for c in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        ends = ",".join(str(c) for c in sorted(members[node]) if built[c] == node)
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA) if isinstance(rows, list) else rows
    return sorted((tuple(r) for r in P.conversation_trie(df, **options).select(*COLUMNS).collect()), key=repr)


def test_double_array_holds_every_edge():
    rng = random.Random(1)
    for width, n in ((1, 50), (3, 400), (400, 2000), (5000, 6000)):
        paths = sorted({tuple(rng.randrange(rng.choice((2, width))) for _ in range(rng.randrange(1, 6))) for _ in range(n)})
        ids, parent, symbol = {(): 0}, [-1], [-1]
        for d in range(1, 6):
            for path in paths:
                if len(path) >= d and path[:d] not in ids:
                    ids[path[:d]] = len(parent)
                    parent.append(ids[path[: d - 1]])
                    symbol.append(path[d - 1])
        base, check, cell = P.pack(np.array(parent), np.array(symbol))
        assert len(set(cell.tolist())) == len(parent) and (check >= 0).sum() == len(parent) - 1
        for v in range(1, len(parent)):
            to = base[cell[parent[v]]] + symbol[v]
            assert to == cell[v] and check[to] == cell[parent[v]]


def test_random_conversations_in_shards_of_any_size(spark):
    rng = random.Random(2)
    rows = []
    for c in rng.sample(range(-250, 900), 500):
        turns = [(rng.choice(["user", "system", None]), rng.choice(["a", "bb", "", None, "é🎉"])) for _ in range(rng.randrange(1, 9))]
        rows += [(c, None if i == 0 and rng.random() < 0.3 else i, r, t) for i, (r, t) in enumerate(turns)]
    rows += rng.sample(rows, 60)
    rng.shuffle(rows)
    want = by_hand(rows)
    for shard in (1, 17, 300, P.SHARD):
        assert found(spark, rows, shard_turns=shard) == want


def test_long_conversations_are_cut_and_mended(spark):
    """Segments of three turns, so that most nodes have members that go on elsewhere."""
    rng = random.Random(3)
    rows = []
    for c in range(120):
        n = rng.choice((1, 2, 3, 4, 6, 7, 13, 40))
        rows += [(c, i, "user", "x" if rng.random() < 0.8 else "y") for i in range(n)]
    want = by_hand(rows)
    for shard in (1, 25, P.SHARD):
        assert found(spark, rows, shard_turns=shard, segment=3) == want


def test_one_conversation_with_most_turns_and_one_shared_by_most(spark):
    rows = [(7, i, "user", f"turn {i % 3}") for i in range(3000)]
    rows += [(c, i, "user", f"hot {i}") for c in range(1000, 1500) for i in range(7)]
    assert found(spark, rows, shard_turns=400) == by_hand(rows)


def test_registered_query_and_its_sql(spark):
    out = queries.op12_trie(spark, DIR)
    assert dict(out.dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in COLUMNS}
    table = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=repr)
    assert rows == by_hand(table)
    sql = connect(DIR).execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLES['op12_trie']})").fetchall()
    assert sorted(sql, key=repr) == rows


def test_odd_inputs(spark):
    rows = [
        (None, 1, "user", "no id"), (None, None, None, None), (1, None, None, None), (1, None, None, None), (1, 5, "user", "x" * 200_000),
        (1, 5, "user", "x" * 200_000), (1, 5, "a", "tie"), (2, 1, "user", ""), (200, 1, "u", "one"), (201, 1, "u", "one"), (-101, 3, "u", "one"),
        (-100, 3, "u", "one"), (12, 1, "user", "a\x00b"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in (
        "key", "chars", "block", "n", "before", "h", "m", "total", "depth", "tier", "x1", "path", "from", "pos", "ends", "kind", "_any")})
    assert found(spark, df) == by_hand(rows)
    assert found(spark, []) == []
    assert found(spark, rows[:2]) == []
