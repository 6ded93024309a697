"""Prefix trie of conversations, packed shard by shard into double arrays.

Sequences of turns are range-partitioned in the order of their paths, so that a shard is a stretch of the trie from one path
to another.  Its turns get dense ids, its nodes are packed into BASE and CHECK (a node's child by turn ``t`` lies in cell
``BASE[node] + t``, and ``CHECK`` of that cell names the node), and all sequences walk the arrays to find their nodes.  Nodes
inside a shard are done there.  Those on its first and last path may go on in the shards beside it; only they are merged
globally.  Long conversations are cut into segments, whose nodes above are shared in the same way, so no conversation, no first
turn and no group of equal conversations is held by one task.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import checkpoint

# Turns in one row, and turns packed into one double array (a shard ends with the row that reaches them).
SEGMENT = 256
SHARD = 1 << 16

_NODE, _BORDER, _PATH, _ENDS = 0, 1, 2, 3
_FOUND = pa.schema([
    ("kind", pa.int32()), ("shard", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("depth", pa.int64()),
    ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("chars", pa.int64()), ("ends", pa.string())])
_FOUND_DDL = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'string' if f.type == pa.string() else 'bigint'}" for f in _FOUND)
_NOBODY = hashlib.sha256(b"").hexdigest()
_ID = ["x1", "x2", "depth"]


def pack(parent: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE, CHECK and the cell of every node of a trie.

    Node 0 is the root; node ``v`` hangs on ``parent[v]`` by ``symbol[v]``, and the children of a node follow each other.
    Nodes with many children are placed first, each at the first base where all their cells are free; single children
    take what is left in order.  CHECK is -1 in free cells.
    """
    n = len(parent)
    first = np.flatnonzero(np.append(True, parent[2:] != parent[1:-1])) + 1 if n > 1 else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, n))
    cell, base_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
    taken = np.zeros(max(2 * n, 64), bool)
    taken[0] = True
    low = 1
    for g in np.argsort(-sizes, kind="stable"):
        if sizes[g] == 1:
            break
        children = np.arange(first[g], first[g] + sizes[g])
        symbols = symbol[children]
        least, span = symbols.min(), int(symbols.max() - symbols.min())
        while low < len(taken) and taken[low]:
            low += 1
        at, window, base = low, 64, None
        while base is None:
            if at + window + span >= len(taken):
                taken = np.append(taken, np.zeros(max(len(taken), window + span), bool))
            tries = at + np.flatnonzero(~taken[at : at + window])
            bases = tries - least
            fits = bases[~taken[bases[:, None] + symbols[None, :]].any(axis=1)] if len(tries) else bases
            base = int(fits[0]) if len(fits) else None
            at += window
            window = min(4 * window, max(64, (1 << 20) // len(symbols)))
        cell[children] = base + symbols
        taken[cell[children]] = True
        base_of[parent[children[0]]] = base
    alone = first[sizes == 1]
    free = np.flatnonzero(~taken)
    if len(free) < len(alone):
        free = np.append(free, np.arange(len(taken), len(taken) + len(alone) - len(free)))
    cell[alone] = free[: len(alone)]
    base_of[parent[alone]] = cell[alone] - symbol[alone]
    base = np.zeros(int(cell.max()) + 1, np.int64)
    check = np.full(len(base), -1, np.int64)
    base[cell] = base_of
    check[cell[1:]] = cell[parent[1:]]
    return base, check, cell


class _Shard:
    """Rows of sequences in order, as dense turn ids by level; level 0 is the segment's own start."""

    def __init__(self, rows: pa.RecordBatch):
        def longs(name: str) -> np.ndarray:
            return rows.column(name).to_numpy(zero_copy_only=False).astype(np.int64)

        def flat(name: str) -> np.ndarray:
            return rows.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)

        self.n = rows.num_rows
        self.conv, self.tier, self.x1, self.x2 = (longs(c) for c in ("conv_id", "tier", "x1", "x2"))
        self.goes_on = ~rows.column("ends").to_numpy(zero_copy_only=False).astype(bool)
        self.length = pc.list_value_length(rows.column("path")).to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.cumsum(self.length) - self.length
        turns = rows.column("path").flatten().dictionary_encode()
        self.turns = turns.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.n_turns = len(turns.dictionary)
        self.chars, self.z1, self.z2 = (flat(c) for c in ("chars", "z1", "z2"))
        differs = (np.diff(self.tier) != 0) | (np.diff(self.x1) != 0) | (np.diff(self.x2) != 0)
        self.start = np.append(0, np.cumsum(differs))
        self.levels = int(self.length.max()) + 1

    def level(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that reach a level, and their symbols there."""
        if d == 0:
            return np.arange(self.n), self.n_turns + self.start
        rows = np.flatnonzero(self.length >= d)
        return rows, self.turns[self.at[rows] + d - 1]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Parent and symbol of every node: equal prefixes follow each other, so a node begins where a prefix changes."""
        parents, symbols, count = [np.array([-1])], [np.array([-1])], 1
        node = np.zeros(self.n, np.int64)
        for d in range(self.levels):
            rows, symbol = self.level(d)
            above = node[rows]
            new = np.append(True, (above[1:] != above[:-1]) | (symbol[1:] != symbol[:-1]))
            parents.append(above[new])
            symbols.append(symbol[new])
            node[rows] = count + np.cumsum(new) - 1
            count += int(new.sum())
        return np.concatenate(parents), np.concatenate(symbols)


def _as_batch(kind: int, shard: int, **columns) -> pa.RecordBatch:
    """Rows of one kind; columns not given are null."""
    n = len(columns["depth"])
    given = {"kind": np.full(n, kind, np.int32), "shard": np.full(n, shard), **columns}
    return pa.RecordBatch.from_arrays(
        [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in _FOUND], schema=_FOUND)


def _masked(values: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=null)


def nodes_of_shard(rows: pa.RecordBatch, number: int, segment: int) -> Iterator[pa.RecordBatch]:
    """Finished nodes, parts of nodes on its border, the border's paths, and who ends on the border."""
    shard = _Shard(rows)
    base, check, _ = pack(*shard.edges())
    size = len(check)
    n_convs, chars, depth, level_of = (np.zeros(size, np.int64) for _ in range(4))
    smallest = np.full(size, np.iinfo(np.int64).max)
    x1, x2 = np.zeros(size, np.int64), np.zeros(size, np.int64)
    border = np.zeros(size, bool)
    on_border = shard.goes_on.copy()
    on_border[[0, -1]] = True

    state, hash1, hash2 = np.zeros(shard.n, np.int64), shard.x1.copy(), shard.x2.copy()
    paths = []
    for d in range(shard.levels):
        at, symbol = shard.level(d)
        to = base[state[at]] + symbol
        if (check[to] != state[at]).any():
            raise AssertionError("a sequence left its trie")
        state[at] = to
        if d:
            turn = shard.at[at] + d - 1
            hash1[at] ^= shard.z1[turn]
            hash2[at] ^= shard.z2[turn]
            chars[to] = shard.chars[turn]
        # A segment's start was counted where the segment before it ends.
        counted = (d > 0) | (shard.tier[at] == 0)
        n_convs += np.bincount(to[counted], minlength=size)
        np.minimum.at(smallest, to[counted], shard.conv[at][counted])
        x1[to], x2[to], depth[to], level_of[to] = hash1[at], hash2[at], shard.tier[at] * segment + d, d
        border[to[on_border[at] | (d == 0)]] = True
        shown = on_border[at] & counted
        paths.append((shard.conv[at][shown], hash1[at][shown], hash2[at][shown], (shard.tier[at] * segment + d)[shown]))
    used = np.flatnonzero(check >= 0)
    used = used[used != 0]
    inside = used[~border[used]]
    all_children = np.bincount(check[used], minlength=size)
    inner_children = np.bincount(check[inside], minlength=size)
    n_leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for d in range(shard.levels - 1, 0, -1):
        here = inside[level_of[inside] == d]
        n_leaves[here] += all_children[here] == 0
        saved[here] += (n_convs[here] - 1) * chars[here]
        np.add.at(n_leaves, check[here], n_leaves[here])
        np.add.at(saved, check[here], saved[here])

    ending = np.flatnonzero(~shard.goes_on)
    ending = ending[np.argsort(state[ending], kind="stable")]
    digests, pieces = {}, []
    for some in np.split(ending, np.flatnonzero(np.diff(state[ending])) + 1) if len(ending) else []:
        at, ids = int(state[some[0]]), ",".join(map(str, shard.conv[some].tolist()))
        if border[at]:
            pieces.append((at, int(shard.conv[some[0]]), ids))
        else:
            digests[at] = hashlib.sha256(ids.encode()).hexdigest()

    above = check[inside]
    yield _as_batch(
        _NODE, number, depth=depth[inside], conv_id=smallest[inside], parent_conv_id=_masked(smallest[above], border[above]),
        p1=_masked(x1[above], ~border[above]), p2=_masked(x2[above], ~border[above]), n_convs=n_convs[inside],
        n_children=all_children[inside], n_leaves=n_leaves[inside], saved=saved[inside],
        ends=[digests.get(c, _NOBODY) for c in inside.tolist()])
    edge = used[border[used]]
    start = level_of[edge] == 0
    yield _as_batch(
        _BORDER, number, x1=x1[edge], x2=x2[edge], depth=depth[edge], conv_id=_masked(smallest[edge], n_convs[edge] == 0),
        p1=_masked(x1[check[edge]], start), p2=_masked(x2[check[edge]], start), n_convs=n_convs[edge],
        n_children=inner_children[edge], n_leaves=n_leaves[edge], saved=saved[edge], chars=chars[edge])
    conv, h1, h2, deep = (np.concatenate(c) for c in zip(*paths))
    yield _as_batch(_PATH, number, conv_id=conv, x1=h1, x2=h2, depth=deep)
    if pieces:
        cells = np.array([p[0] for p in pieces])
        yield _as_batch(
            _ENDS, number, x1=x1[cells], x2=x2[cells], depth=depth[cells], conv_id=[p[1] for p in pieces], ends=[p[2] for p in pieces])


def _in_shards(shard_turns: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, turns = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            lengths = pc.list_value_length(batch.column("path")).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            reached, begin = turns + np.cumsum(lengths), 0
            while len(reached) and reached[-1] >= shard_turns:
                cut = int(np.searchsorted(reached, shard_turns)) + 1
                waiting.append(batch.slice(begin, cut))
                yield from nodes_of_shard(pa.concat_batches(waiting), number, segment)
                number, waiting, begin = number + 1, [], begin + cut
                reached = reached[cut:] - reached[cut - 1]
            if begin < batch.num_rows:
                waiting.append(batch.slice(begin))
            turns = int(reached[-1]) if len(reached) else 0
        if waiting:
            yield from nodes_of_shard(pa.concat_batches(waiting), number, segment)

    return run


def _digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of lists of ids, in order, hashed as a stream: a list of any length is never held."""
    key, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"x1": key[0], "x2": key[1], "depth": key[2], "sha": digest.hexdigest()}],
            schema=pa.schema([("x1", pa.int64()), ("x2", pa.int64()), ("depth", pa.int64()), ("sha", pa.string())]))

    for batch in batches:
        for x1, x2, depth, ids in zip(*(batch.column(c) for c in (*_ID, "ends"))):
            own = (x1.as_py(), x2.as_py(), depth.as_py())
            if own == key:
                digest.update(b",")
            else:
                if key:
                    yield row()
                key, digest = own, hashlib.sha256()
            digest.update(ids.as_py().encode())
    if key:
        yield row()


def trie_nodes(turns: DataFrame, convs: DataFrame, shard_turns: int = SHARD, segment: int = SEGMENT) -> DataFrame:
    """One row per distinct prefix of the conversations.

    ``turns (conv_id, depth, key, chars, total)`` has every turn at its place from 1 without gaps; turns are equal where ``key``
    is.  ``convs (conv_id, total)`` has every conversation with its number of turns, of which there may be none.  Result:
    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    Without conversations there is no node, not even the root.

    Nodes are told apart by depth and 128 bits.  The list of conversations that end at one node is hashed in order,
    so by one task for each node, which holds a piece of it at a time.
    """
    def tier_of(depth: Column) -> Column:
        return F.greatest(F.floor((depth - 1) / F.lit(segment)), F.lit(0)).cast("bigint")

    placed = turns.select("conv_id", "depth", "key", "chars", "total", tier_of(F.col("depth")).alias("tier")).withColumns({
        "z1": F.xxhash64("key", "depth", F.lit(1)), "z2": F.xxhash64("key", "depth", F.lit(2))})
    segments = placed.groupBy("conv_id", "tier").agg(
        F.sort_array(F.collect_list(F.struct("depth", "key", "chars", "z1", "z2"))).alias("turns"),
        F.bit_xor("z1").alias("own1"), F.bit_xor("z2").alias("own2"), F.max("total").alias("total"))
    segments = checkpoint(segments)
    earlier = Window.partitionBy("conv_id").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.filter(F.col("total") > segment).select(
        "conv_id", "tier", *[F.coalesce(F.bit_xor(f"own{i}").over(earlier), F.lit(0)).alias(f"x{i}") for i in (1, 2)])
    short = segments.filter(F.col("total") <= segment).withColumns({"x1": F.lit(0).cast("bigint"), "x2": F.lit(0).cast("bigint")})
    long = segments.filter(F.col("total") > segment).join(starts, ["conv_id", "tier"])
    columns = ["conv_id", "tier", "x1", "x2", "total", "turns"]
    rows = short.select(*columns).unionByName(long.select(*columns)).select(
        "conv_id", "tier", "x1", "x2", (F.col("tier") == tier_of(F.col("total"))).alias("ends"), F.col("turns.key").alias("path"),
        *[F.col(f"turns.{c}").alias(c) for c in ("chars", "z1", "z2")])
    silent = convs.filter("total = 0").selectExpr(
        "conv_id", "0L AS tier", "0L AS x1", "0L AS x2", "true AS ends", "cast(array() AS array<binary>) AS path",
        *[f"cast(array() AS array<bigint>) AS {c}" for c in ("chars", "z1", "z2")])
    order = ["tier", "x1", "x2", "path", "conv_id"]
    rows = rows.unionByName(silent).repartitionByRange(*order).sortWithinPartitions(*order)
    found = checkpoint(rows.mapInArrow(_in_shards(shard_turns, segment), _FOUND_DDL))

    parts = found.filter(F.col("kind") == _BORDER)
    merged = parts.groupBy(*_ID).agg(
        F.min("conv_id").alias("conv_id"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("chars").alias("chars"))
    below = merged.filter("depth > 0").groupBy("p1", "p2", "depth").agg(F.count("*").alias("outer")).select(
        F.col("p1").alias("x1"), F.col("p2").alias("x2"), (F.col("depth") - 1).alias("depth"), "outer")
    merged = checkpoint(merged.join(below, _ID, "left").withColumn("n_children", F.col("inner") + F.coalesce("outer", F.lit(0))))

    # A border node hands its own numbers to all nodes above it, along the path of one conversation that has it: sums from
    # the end of each path, taken in segments.
    path = found.filter(F.col("kind") == _PATH).select("conv_id", *_ID)
    owner = path.groupBy(*_ID).agg(F.min("conv_id").alias("owner"))
    own = merged.join(owner, _ID).select(
        *_ID, "owner", (F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint")).alias("leaf"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("save"))
    mine = F.col("conv_id") == F.col("owner")
    path = path.join(own, _ID).select(
        "conv_id", *_ID, tier_of(F.col("depth")).alias("tier"), F.when(mine, F.col("leaf")).otherwise(0).alias("leaf"),
        F.when(mine, F.col("save")).otherwise(0).alias("save"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("tier")).rowsBetween(Window.unboundedPreceding, -1)
    tails = path.groupBy("conv_id", "tier").agg(F.sum("leaf").alias("leaf"), F.sum("save").alias("save")).select(
        "conv_id", "tier", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_tail") for c in ("leaf", "save")])
    up = Window.partitionBy("conv_id", "tier").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = path.withColumns({c: F.sum(c).over(up) for c in ("leaf", "save")}).join(tails, ["conv_id", "tier"])
    sums = sums.groupBy(*_ID).agg(
        F.sum(F.col("leaf") + F.col("leaf_tail")).alias("n_leaves"), F.sum(F.col("save") + F.col("save_tail")).alias("saved_tokens"))

    # Nodes hung on a border node look its conversation up by shard: a node may have many children, a shard has few.
    # One shard may hold the end of a segment and the start of the next.
    known = parts.select("shard", *_ID).distinct().join(merged.select(*_ID, "conv_id"), _ID).select(
        "shard", F.col("x1").alias("p1"), F.col("x2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    inner = found.filter(F.col("kind") == _NODE).join(known, ["shard", "p1", "p2", "depth"], "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))

    pieces = found.filter(F.col("kind") == _ENDS).select(*_ID, "conv_id", "ends")
    ends = pieces.repartition(*_ID).sortWithinPartitions(*_ID, "conv_id").mapInArrow(
        _digest_pieces, "x1 bigint, x2 bigint, depth bigint, sha string")
    parent = merged.select(
        F.col("x1").alias("p1"), F.col("x2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    outer = merged.select(*_ID, "p1", "p2", "conv_id", "n_convs", "n_children").join(sums, _ID).join(ends, _ID, "left")
    outer = outer.join(parent, ["p1", "p2", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(_NOBODY)).alias("ends_sha256"))
    return inner.unionByName(outer)


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, block, turn, key, chars)`` of all turns, and ``(conv_id, block, n, before)`` of their blocks.

    Turns are in the order of ``turn``, null first, then of ``key``; blocks are ranges of that order and split a
    conversation of any length.  Role and text count as empty where null; rows without a ``conv_id`` belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))).alias("key"),
        F.char_length(text).cast("bigint").alias("chars"), F.monotonically_increasing_id().alias("_any"))
    rows = rows.repartitionByRange("conv_id", "turn", "key", "_any").drop("_any").withColumn("block", F.spark_partition_id())
    rows = checkpoint(rows)
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows, blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def conversation_trie(
    conversations: DataFrame, group: int = 100, heads: int = 6, shard_turns: int = SHARD, segment: int = SEGMENT,
) -> DataFrame:
    """Trie of conversations rebuilt so that those of a group share beginnings.

    Conversation ``c`` begins with the first ``h = crc32(c) % heads`` turns of ``c - c % group`` (all if it has fewer, none
    if there is no such conversation; the remainder has the sign of ``c``) and goes on with its own after its first ``h``.
    Repeated rows are turns of their own; where a conversation has several rows of one ``turn`` the digest of role and text
    decides their order.
    """
    rows, blocks = numbered(conversations)
    sizes = blocks.groupBy("conv_id").agg(F.sum("n").alias("n"))
    convs = sizes.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"),
                         (F.col("conv_id") - F.col("conv_id") % group).alias("from"))
    givers = sizes.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("from"), F.col("n").alias("n_from"))
    convs = convs.join(givers, "from", "left").withColumn("m", F.least("h", F.coalesce("n_from", F.lit(0))))
    convs = checkpoint(convs.withColumn("total", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))

    places = blocks.join(convs.select("conv_id", "h", "m", "total"), "conv_id")
    in_block = Window.partitionBy("conv_id", "block").orderBy("turn", "key")
    placed = rows.join(places, ["conv_id", "block"]).withColumn("pos", F.col("before") + F.row_number().over(in_block))
    own = placed.filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "key", "chars", "total")
    given = placed.filter((F.col("conv_id") % group == 0) & (F.col("pos") < heads)).select(F.col("conv_id").alias("from"), "pos", "key", "chars")
    given = given.join(convs.filter("m > 0").select("from", "conv_id", "m", "total"), "from").filter("pos <= m")
    given = given.select("conv_id", F.col("pos").alias("depth"), "key", "chars", "total")
    return trie_nodes(own.unionByName(given), convs, shard_turns, segment)
