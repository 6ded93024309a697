"""Near duplicates by SimHash, found through tables of distances to reference fingerprints.

A fingerprint has one bit per hash bit: set where more than half of the shingles' hashes have it set.  Its
distances to reference fingerprints (pivots) are kept in tables, and a pair can be near only if no distance
differs by more than the radius.

*Block pivots* agree with each other outside a block of 16 bits, so a pair equal on a block has equal distances
to all of them: these coordinates are the key of a *cell*.  *Full pivots* spread over all bits: inside a cell
they discard pairs by the largest difference of coordinates, and the bits of the survivors are compared.

With radius 2 on 64 bits a near pair is equal on two of four blocks at least, so the six pairs of blocks find
every link.  Wider radii use many blocks drawn from longer fingerprints; what they find is verified by
the Jaccard similarity of the texts' shingles.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field, replace
from itertools import combinations
from math import ceil, log1p
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import checkpoint, components, group_starts, shingles_of, text_hash, whole_groups, words_of

BLOCK_BITS = 16
_SEED = 42
_GOLDEN = 0x9E3779B97F4A7C15
# A cell of up to _SMALL fingerprints is compared pair by pair, up to _CELL as one matrix.
_SMALL, _CELL = 32, 1024
# Rows of cells are compared this many at a time, and so many pairs of them at once.
_GATHERED, _PAIRS = 1 << 14, 1 << 16
_BLOCK_PIVOTS, _FULL_PIVOTS = 12, 16
# Shingles of texts that a task keeps while it compares pairs.
_KEPT = 1 << 18


@dataclass(frozen=True)
class SimHashPlan:
    """Shingle length in words, fingerprint length in 64-bit words, Hamming radius, cell tables.

    ``tables`` is the number of blocks of ``block_bits`` bits drawn at random, or 0 for the pairs of fixed 16-bit
    blocks, which miss nothing up to radius 2.  ``jaccard`` is the similarity that a link must have besides, or None.
    """

    shingle: int = 3
    length: int = 1
    radius: int = 2
    tables: int = 0
    jaccard: float | None = None
    block_bits: int = BLOCK_BITS
    blocks: tuple = field(init=False)

    @property
    def coordinates(self) -> int:
        """Bytes of coordinates that a row of a cell carries: distances up to 64 fit one byte each."""
        return _FULL_PIVOTS if self.length == 1 else 0

    def __post_init__(self):
        if not self.tables and self.radius > 2:
            raise ValueError("fixed blocks find pairs up to radius 2 only")
        bits = 64 * self.length
        if self.tables:
            rng = np.random.default_rng(_SEED)
            drawn = [rng.choice(bits, self.block_bits, replace=False) for _ in range(self.tables)]
            # A block longer than the pivots' table is looked up in parts.
            parts = -(-self.block_bits // BLOCK_BITS)
            chosen = [tuple(tuple(int(b) for b in part) for part in np.array_split(block, parts)) for block in drawn]
        else:
            fixed = [tuple(range(i, i + BLOCK_BITS)) for i in range(0, bits, BLOCK_BITS)]
            chosen = list(combinations(fixed, len(fixed) - self.radius))
        object.__setattr__(self, "blocks", tuple(chosen))


# Links at two bits or fewer over three-word shingles.
EXACT = SimHashPlan()
# Five-word shingles and a Jaccard similarity of 0.8, where about 39 of 256 bits differ, 48 in texts of eight and nine
# words.  The radius only spares unlike texts (128 bits) the test: 72 is nearly four standard deviations above 48.  A
# pair shares one of the 64 cells with a probability of about 0.99, of 0.97 where 48 bits differ.
_ALIKE_BITS = 39 / 256
CORPUS = SimHashPlan(shingle=5, length=4, radius=72, tables=64, jaccard=0.8, block_bits=14)


# A cell holds this many texts on average at most.
_TEXTS_A_CELL = 1024


def plan_for(texts: int, plan: SimHashPlan = CORPUS) -> SimHashPlan:
    """The plan with blocks as long as the number of texts asks for, and as many tables as keep its recall.

    A longer block is shared less often by texts that are alike, which more tables make up for: with ``p`` the
    probability to share one block, ``(1 - p) ** tables`` stays what it is for ``plan``.
    """
    bits = max(plan.block_bits, (max(texts, 1) // _TEXTS_A_CELL).bit_length())
    if not plan.tables or bits == plan.block_bits:
        return plan
    share = [(1 - _ALIKE_BITS) ** n for n in (plan.block_bits, bits)]
    tables = ceil(plan.tables * log1p(-share[0]) / log1p(-share[1]))
    return replace(plan, block_bits=bits, tables=tables)


def _spread(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, plan: SimHashPlan = EXACT) -> bytes:
    """SimHash of one text, most significant bit first; all zero for a text without words.

    Shingles count as often as they occur, or once where the Jaccard similarity of their sets is what matters.
    """
    shingles = shingles_of(words_of(text), plan.shingle)
    if plan.jaccard is not None:
        shingles = list(set(shingles))
    counts = np.zeros(64 * plan.length, np.int64)
    for at in range(0, len(shingles), 1 << 14):
        part = shingles[at : at + (1 << 14)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, _SEED) for s in part), np.uint64, len(part))
        more = [_spread(hashes + np.uint64(j * _GOLDEN % (1 << 64))) for j in range(1, plan.length)]
        wide = np.stack([hashes, *more], axis=1).astype(">u8")
        bits = np.unpackbits(wide.view(np.uint8), axis=1).view(np.uint64)
        # Eight one-byte counters in each number: exact for up to 255 rows at a time.
        for i in range(0, len(part), 255):
            counts += np.add.reduce(bits[i : i + 255], axis=0).view(np.uint8)
    return np.packbits(counts * 2 > len(shingles)).tobytes()


def fingerprints(docs: DataFrame, plan: SimHashPlan = EXACT) -> DataFrame:
    """``(doc_id, text_key, sig)`` per row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [fingerprint(t.as_py(), plan) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sigs, pa.binary())],
                ["doc_id", "text_key", "sig"],
            )

    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(F.col("text")).alias("text_key"), "text")
    return known.mapInArrow(run, "doc_id bigint, text_key binary, sig binary")


def _as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of one width, none of them null, as they lie in the array."""
    if not len(column):
        return np.empty((0, width), np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    first, last = int(ends[column.offset]), int(ends[column.offset + len(column)])
    return np.frombuffer(column.buffers()[2], np.uint8)[first:last].reshape(-1, width)


def _block_table() -> np.ndarray:
    """Coordinates of every 16-bit value: its distances to the block pivots, packed into one number."""
    pivots = np.random.default_rng(_SEED + 1).integers(0, 1 << BLOCK_BITS, _BLOCK_PIVOTS)
    values = np.arange(1 << BLOCK_BITS)
    distances = np.bitwise_count(values[:, None] ^ pivots[None, :]).astype(np.uint64)
    return distances @ np.uint64(BLOCK_BITS + 1) ** np.arange(_BLOCK_PIVOTS, dtype=np.uint64)


def _full_pivots(width: int) -> np.ndarray:
    return np.random.default_rng(_SEED + 2).integers(0, 1 << 63, (_FULL_PIVOTS, width // 8), np.uint64) * np.uint64(2)


class _CellKeys:
    """Keys of the cells of fingerprints, one per table."""

    def __init__(self, plan: SimHashPlan):
        self.coordinates = _block_table()
        blocks = [b for table in plan.blocks for b in table]
        self.weights = np.zeros((64 * plan.length, len(blocks)), np.float32)
        for j, block in enumerate(blocks):
            self.weights[list(block), j] = 2.0 ** np.arange(len(block))
        self.tables, self.per_table = len(plan.blocks), len(plan.blocks[0])

    def of(self, sigs: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(sigs, axis=1)
        place = self.coordinates[(bits.astype(np.float32) @ self.weights).astype(np.int64)].reshape(len(sigs), -1, self.per_table)
        key = np.arange(self.tables, dtype=np.uint64)[None, :] * np.uint64(_GOLDEN)
        for i in range(self.per_table):
            key = _spread(key ^ place[:, :, i])
        return key.view(np.int64)


def cells(sigs: DataFrame, plan: SimHashPlan, *carried: str) -> DataFrame:
    """``(cell, sig, *carried)``: each row once per table, under the key of its fingerprint's block coordinates.

    Short fingerprints are followed by their coordinates, which are so computed once for all cells they are in.
    """

    names = ["sig", *carried]
    width, coordinates = 8 * plan.length, plan.coordinates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, pivots = _CellKeys(plan), _full_pivots(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sigs = _as_matrix(part.column("sig"), width)
                key = keys.of(sigs)
                rows = pa.array(np.repeat(np.arange(len(key)), key.shape[1]))
                first = part.column("sig")
                if coordinates:
                    table = pivot_table(sigs.view(np.uint64), pivots).astype(np.uint8)
                    first = pa.array([r.tobytes() for r in np.concatenate([sigs, table], axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel()), first.take(rows), *(part.column(c).take(rows) for c in carried)], ["cell", *names]
                )

    return sigs.select(*names).mapInArrow(run, "cell bigint, " + ", ".join(f"{c} binary" for c in names))


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of sorted cells, cut so that no cell is split unless it has more than ``_CELL`` rows."""
    keys, sigs = np.empty(0, np.int64), np.empty((0, width), np.uint8)
    waiting: list[pa.RecordBatch] = []

    def joined() -> tuple[np.ndarray, np.ndarray]:
        parts = [_as_matrix(b.column("sig"), width) for b in waiting]
        return np.concatenate([keys, *(b.column("cell").to_numpy() for b in waiting)]), np.concatenate([sigs, *parts])

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) < _GATHERED:
            continue
        keys, sigs = joined()
        waiting.clear()
        last = int(np.searchsorted(keys, keys[-1]))
        if len(keys) - last > _CELL:
            last = len(keys)
        yield keys[:last], sigs[:last]
        keys, sigs = keys[last:], sigs[last:]
    yield joined()


def pivot_table(words: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of fingerprints to all full pivots, one row each: their coordinates."""
    return np.stack([np.bitwise_count(words ^ p).sum(axis=1, dtype=np.int16) for p in pivots], axis=1)


def not_discarded(table: np.ndarray, first: np.ndarray, second: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs may be within the radius: no coordinate differs by more."""
    keep = np.ones(len(first), bool)
    for at in range(0, table.shape[1], 4):
        left = np.flatnonzero(keep)
        keep[left] = (np.abs(table[first[left], at : at + 4] - table[second[left], at : at + 4]) <= radius).all(axis=1)
    return keep


def _near(words: np.ndarray, table: np.ndarray, first: np.ndarray, second: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of rows are within the radius: coordinates look it up first, the bits of the survivors verify it."""
    keep = not_discarded(table, first, second, radius)
    left = np.flatnonzero(keep)
    keep[left] = np.bitwise_count(words[first[left]] ^ words[second[left]]).sum(axis=1, dtype=np.int16) <= radius
    return keep


def _near_in_cell(words: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of one cell within the radius: candidates share a window of the first coordinate."""
    order = np.argsort(table[:, 0], kind="stable")
    along = table[order, 0]
    ends = np.searchsorted(along, along + radius, side="right")
    found = []
    for at in range(0, len(order), 64):
        n = ends[at : at + 64] - np.arange(at, min(at + 64, len(order))) - 1
        first = np.repeat(np.arange(at, at + len(n)), n)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        x, y = order[first], order[second]
        hit = _near(words, table, x, y, radius)
        found.append((x[hit], y[hit]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of every row of ``x`` to every row of ``y``, or of each of a stack of ``x`` to its ``y``."""
    out = np.zeros((*x.shape[:-1], y.shape[-2]), np.int16)
    for i in range(x.shape[-1]):
        a, b = np.ascontiguousarray(x[..., i]), np.ascontiguousarray(y[..., i])
        out += np.bitwise_count(a[..., :, None] ^ b[..., None, :])
    return out


def _near_in_cells(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within the radius of rows in one cell.  Cells of one size are compared side by side, each pair once."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for n in np.unique(sizes[sizes > 1]):
        alike = starts[sizes == n]
        step = max(1, _PAIRS // (n * n))
        for at in range(0, len(alike), step):
            rows = alike[at : at + step, None] + np.arange(n)
            here = words[rows]
            hit = np.flatnonzero(_distances(here, here) <= radius)
            cell, x, y = hit // (n * n), hit // n % n, hit % n
            once = x < y
            found.append((rows[cell[once], x[once]], rows[cell[once], y[once]]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _spanning(words: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all rows within the radius of each other into their components."""
    first, second = _near_in_cell(words, table, radius)
    label = np.arange(len(words))
    while True:
        lower = label.copy()
        np.minimum.at(lower, first, label[second])
        np.minimum.at(lower, second, label[first])
        if (lower == label).all():
            break
        label = lower
    child = np.flatnonzero(label != np.arange(len(words)))
    return child, label[child]


def _most_central(first: np.ndarray, second: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of near pairs of rows: each row, the most central row near it, and how many rows that has near it.

    A row is more central the more rows are near it; the most central of all hang on none.
    """
    degree = np.bincount(first, minlength=n) + np.bincount(second, minlength=n)
    rows, others = np.concatenate([first, second]), np.concatenate([second, first])
    up = (degree[others] > degree[rows]) | ((degree[others] == degree[rows]) & (others < rows))
    rows, others = rows[up], others[up]
    order = np.lexsort((-others, degree[others], rows))
    rows, others = rows[order], others[order]
    last = np.flatnonzero(np.append(rows[1:] != rows[:-1], True)) if len(rows) else np.empty(0, np.int64)
    return rows[last], others[last], degree[others[last]]


class _Stars:
    """Rows of one large cell, hung on centres: those nearest to the many around them."""

    def __init__(self, radius: int):
        self.radius, self.centres, self.degrees = radius, None, np.empty(0, np.int64)

    def add(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Linked rows, their centres, and how many rows are near those."""
        if self.centres is not None:
            for at in range(0, len(self.centres), _CELL):
                centres = self.centres[at : at + _CELL]
                d = _distances(words, centres)
                best = d.argmin(axis=1)
                hit = d[np.arange(len(words)), best] <= self.radius
                np.add.at(self.degrees, at + best[hit], 1)
                yield words[hit], centres[best[hit]], self.degrees[at + best[hit]]
                words = words[~hit]
        if not len(words):
            return
        # Rows are compared once; what goes with a centre is taken off the weights of those that stay.
        weight = np.maximum(self.radius + 1 - _distances(words, words), 0)
        total, left = weight.sum(axis=1, dtype=np.int64), np.ones(len(words), bool)
        new, degrees = [], []
        while left.any():
            centre = int(np.where(left, total, -1).argmax())
            if total[centre] == self.radius + 1:  # no row that is left is near another
                break
            mine = left & (weight[centre] > 0)
            left &= ~mine
            total -= weight[:, mine].sum(axis=1, dtype=np.int64)
            mine[centre] = False
            n = int(mine.sum())
            yield words[mine], np.broadcast_to(words[centre], (n, words.shape[1])), np.full(n, n)
            new.append(centre), degrees.append(n)
        lone = np.flatnonzero(left)
        new = words[np.concatenate([np.array(new, np.int64), lone])]
        self.centres = new if self.centres is None else np.concatenate([self.centres, new])
        self.degrees = np.concatenate([self.degrees, np.array(degrees, np.int64), np.zeros(len(lone), np.int64)])


def links_in_cells(cell_rows: DataFrame, plan: SimHashPlan) -> DataFrame:
    """``(a, b, degree)`` of fingerprints within the radius that share a cell; ``(a, null)`` for those of crowded cells.

    Cells arrive sorted and are streamed.  Without a Jaccard test a crowded cell is only marked, for
    ``links_of_crowded``.  With one every row is hung on the most central row near it, and ``degree`` tells how many
    rows are near that one, so a cell makes no more links than it has rows; rows that may be near others but are not
    linked are given as ``(a, null)``, for ``pairs_apart``.
    """
    width, coordinates = 8 * plan.length, plan.coordinates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = _full_pivots(width)
        crowded, stars = None, None
        for keys, sigs in _runs(batches, width + coordinates):
            words = np.ascontiguousarray(sigs[:, :width]).view(np.uint64)
            found: list[tuple] = []
            edges = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
            sizes = ends - starts
            if plan.jaccard is None:
                table = sigs[:, width:].astype(np.int16) if coordinates else pivot_table(words, pivots)
                small = np.repeat(sizes <= _SMALL, sizes)
                for d in range(1, _SMALL):
                    first = np.flatnonzero((keys[:-d] == keys[d:]) & small[:-d]) if len(keys) > d else []
                    if not len(first):
                        break
                    first = first[_near(words, table, first, first + d, plan.radius)]
                    found.append((words[first], words[first + d]))
            else:
                # No difference of coordinates is above a radius as wide as this: the bits alone decide.
                whole = sizes <= _CELL
                first, second = _near_in_cells(words, starts[whole], sizes[whole], plan.radius)
                in_small = np.repeat(sizes <= _SMALL, sizes)
                few = in_small[first]
                row, centre, degree = _most_central(first[few], second[few], len(words))
                found.append((words[row], words[centre], degree))
                met = np.union1d(first, second)
                found.append((words[np.setdiff1d(met[in_small[met]], np.union1d(row, centre))], None))
            for s, e in zip(starts[sizes > _SMALL], ends[sizes > _SMALL]):
                here = words[s:e]
                if e - s > _CELL or keys[s] == crowded:
                    if keys[s] != crowded:
                        crowded, stars = keys[s], _Stars(plan.radius)
                    found.append((here, None))
                    if plan.jaccard is not None:
                        for at in range(0, len(here), _CELL):
                            found.extend(stars.add(here[at : at + _CELL]))
                elif plan.jaccard is None:
                    child, parent = _spanning(here, table[s:e], plan.radius)
                    found.append((here[child], here[parent]))
                else:
                    # Rows that are near none can neither hang nor be hung on.
                    here = words[met[np.searchsorted(met, s) : np.searchsorted(met, e)]]
                    found.append((here, None))
                    found.extend(_Stars(plan.radius).add(here))
            # A crowded cell may end in a piece of a few rows, or of one.
            for s, e in zip(starts[sizes <= _SMALL], ends[sizes <= _SMALL]) if crowded is not None else ():
                if keys[s] == crowded:
                    found.append((words[s:e], None))
                    found.extend(() if plan.jaccard is None else stars.add(words[s:e]))
            for a, b, *degree in found:
                if len(a):
                    left = pa.array([r.tobytes() for r in a], pa.binary())
                    right = pa.nulls(len(a), pa.binary()) if b is None else pa.array([r.tobytes() for r in b], pa.binary())
                    degrees = pa.array(degree[0].astype(np.int32)) if degree else pa.nulls(len(a), pa.int32())
                    yield pa.RecordBatch.from_arrays([left, right, degrees], ["a", "b", "degree"])

    ordered = cell_rows.repartition("cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(run, "a binary, b binary, degree int")


def _blocks_apart(words: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within the radius that have different roots, at the cost of all rows times those not of the largest."""
    counts = np.unique(roots, return_inverse=True, return_counts=True)
    order = np.argsort(counts[1] == counts[2].argmax(), kind="stable")
    others = len(order) - int(counts[2].max())
    for at in range(0, others, _CELL):
        x = order[at : min(at + _CELL, others)]
        for to in range(at, len(order), _CELL):
            y = order[to : to + _CELL]
            near = (_distances(words[x], words[y]) <= radius) & (roots[x][:, None] != roots[y][None, :])
            i, j = np.nonzero(near)
            if to == at:
                i, j = i[i < j], j[i < j]
            yield x[i], y[j]


def pairs_apart(cell_rows: DataFrame, plan: SimHashPlan) -> DataFrame:
    """``(a, b)``: all pairs of ``(cell, sig, node, root)`` within the radius that share a cell and have different roots.

    A pair is given once, by the first of the cells it shares.  Cells are sorted and streamed, one whole cell in memory.
    """
    width = 8 * plan.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _CellKeys(plan)
        for batch in whole_groups(batches, "cell", _GATHERED):
            keys, sigs = batch.column("cell").to_numpy(), _as_matrix(batch.column("sig"), width)
            roots = batch.column("root").dictionary_encode().indices.to_numpy()
            words = sigs.view(np.uint64)
            starts = np.flatnonzero(group_starts(batch.column("cell")))
            sizes = np.diff(np.append(starts, len(keys)))
            mixed = np.minimum.reduceat(roots, starts) != np.maximum.reduceat(roots, starts)
            small = mixed & (sizes <= _SMALL)

            def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                x, y = _near_in_cells(words, starts[small], sizes[small], plan.radius)
                apart = roots[x] != roots[y]
                yield x[apart], y[apart]
                for s, n in zip(starts[mixed & (sizes > _SMALL)], sizes[mixed & (sizes > _SMALL)]):
                    for x, y in _blocks_apart(words[s : s + n], roots[s : s + n], plan.radius):
                        yield s + x, s + y

            for left, right in found():
                for at in range(0, len(left), _CELL):
                    x, y = left[at : at + _CELL], right[at : at + _CELL]
                    mine = tables.of(sigs[x])
                    same = mine == tables.of(sigs[y])
                    once = keys[x] == mine[np.arange(len(x)), same.argmax(axis=1)]
                    x, y = pa.array(x[once]), pa.array(y[once])
                    yield pa.RecordBatch.from_arrays([batch.column("node").take(x), batch.column("node").take(y)], ["a", "b"])

    ordered = cell_rows.repartition("cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(run, "a binary, b binary")


def links_of_crowded(sigs: DataFrame) -> DataFrame:
    """Links at two bits or fewer between any of the fingerprints, whatever their number.

    Two of them are that near exactly if they have a common neighbour one flip away or less, and a
    neighbour has 65 fingerprints around it at most, all within two bits of each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                column = batch.column("sig").slice(at, 1024)
                words = _as_matrix(column, 8).copy().view(np.uint64)
                around = (words ^ flips[None, :]).ravel()
                rows = np.repeat(np.arange(len(column)), len(flips))
                yield pa.RecordBatch.from_arrays([pa.array(around.view(np.int64)), column.take(pa.array(rows))], ["n", "sig"])

    near = sigs.select("sig").mapInArrow(run, "n bigint, sig binary").groupBy("n")
    found = near.agg(F.min("sig").alias("b"), F.collect_set("sig").alias("all")).filter("size(all) > 1")
    return found.select(F.explode("all").alias("a"), "b").filter("a <> b").distinct()


def linked(sigs: DataFrame, plan: SimHashPlan = EXACT) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints ``sig``, enough of them to join what belongs together."""
    found = checkpoint(links_in_cells(cells(sigs, plan), plan).select("a", "b").distinct())
    crowded = found.filter("b IS NULL").select(F.col("a").alias("sig"))
    return found.filter("b IS NOT NULL").unionByName(links_of_crowded(crowded))


def _jaccard(x: frozenset, y: frozenset) -> float:
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


class _ShingleSets:
    """Shingle sets of texts; those used last are kept, up to ``_KEPT`` shingles, as a text is in many pairs."""

    def __init__(self, n: int):
        self.n, self.size, self.sets = n, 0, OrderedDict()

    def of(self, key: bytes, text: pa.StringScalar) -> frozenset:
        if key in self.sets:
            self.sets.move_to_end(key)
        else:
            self.sets[key] = frozenset(shingles_of(words_of(text.as_py()), self.n))
            self.size += len(self.sets[key])
        found = self.sets[key]
        while self.size > _KEPT and len(self.sets) > 2:
            self.size -= len(self.sets.popitem(last=False)[1])
        return found


def _bodies(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(text_key, text)`` of the texts ``(text_key, doc_id)``, each fetched once."""
    needed = texts.select(F.col("text_key").alias("_k"), F.col("doc_id").alias("_d"))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_hash(F.col("text")).alias("text_key"))
    found = own.join(needed, (F.col("text_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    return checkpoint(found.select("text_key", "text").dropDuplicates(["text_key"]))


def _verified(pairs: DataFrame, bodies: DataFrame, plan: SimHashPlan) -> DataFrame:
    """Pairs of text keys whose texts are similar enough."""
    left = bodies.select(F.col("text_key").alias("a"), F.col("text").alias("x"))
    right = bodies.select(F.col("text_key").alias("b"), F.col("text").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _ShingleSets(plan.shingle)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = [
                _jaccard(sets.of(i, p), sets.of(j, q)) >= plan.jaccard
                for i, j, p, q in zip(a, b, batch.column("x"), batch.column("y"))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a binary, b binary")


def _similar_links(docs: DataFrame, texts: DataFrame, plan: SimHashPlan) -> DataFrame:
    """``(a, b)``: links between distinct texts ``(text_key, sig, doc_id)``, verified by Jaccard similarity.

    Every fingerprint is first tried with the most central one it was hung on, which settles large groups at the
    cost of a pair per text.  Then every text that may be near another goes back to its cells, and all pairs there
    that are still apart are tried: a link that failed settles nothing.
    """
    heads = checkpoint(texts.groupBy("sig").agg(F.min("text_key").alias("head"), F.count("*").alias("n")))
    raw = links_in_cells(cells(heads.select("sig"), plan), plan)
    raw = checkpoint(raw.groupBy("a", "b").agg(F.max("degree").alias("degree")))
    near = raw.select(F.col("a").alias("sig")).union(raw.filter("b IS NOT NULL").select("b"))
    met = near.union(heads.filter("n > 1").select("sig")).distinct()
    nodes = checkpoint(texts.join(met, "sig").join(heads.select("sig", "head"), "sig"))
    bodies = _bodies(docs, nodes)
    named = nodes.filter("text_key = head").select("sig", "head")
    twins = nodes.filter("text_key <> head").select(F.col("text_key").alias("a"), F.col("head").alias("b"))
    best = raw.filter("b IS NOT NULL").groupBy("a").agg(F.max_by("b", F.struct("degree", "b")).alias("b"))
    best = best.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    first = checkpoint(_verified(best.unionByName(twins), bodies, plan))
    place = nodes.join(components(first).withColumnRenamed("node", "text_key"), "text_key", "left")
    place = place.select("sig", F.col("text_key").alias("node"), F.coalesce("root", "text_key").alias("root"))
    apart = checkpoint(pairs_apart(cells(checkpoint(place), plan, "node", "root"), plan))
    return first.unionByName(_verified(apart, bodies, plan))


def near_duplicates(docs: DataFrame, plan: SimHashPlan = EXACT) -> DataFrame:
    """``(doc_id, text_key, sig, component_id, node_id)`` per row of ``docs (doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` that links lead to, itself included.  A null text is empty; texts
    without words have the fingerprint zero and link like any other.  Rows without ``doc_id`` belong to their
    component but never name it (null if nothing else does; ``node_id`` tells components apart even then).  Repeated rows stay repeated.  Other columns are
    not looked at.

    Equal fingerprints (equal texts, where a Jaccard similarity is asked for) are collapsed by a partial
    aggregation before anything is compared, so copies cost one row each, however many they are.
    """
    rows = checkpoint(fingerprints(docs, plan))
    if plan.jaccard is None:
        node, links = "sig", linked(rows.select("sig").distinct(), plan)
    else:
        node = "text_key"
        texts = checkpoint(rows.groupBy("text_key").agg(F.min("sig").alias("sig"), F.min("doc_id").alias("doc_id")))
        links = _similar_links(docs, texts, plan_for(texts.count(), plan))
    roots = components(links)
    smallest = rows.groupBy(F.col(node).alias("node")).agg(F.min("doc_id").alias("own"))
    joined = roots.join(smallest, "node").groupBy("root").agg(F.min("own").alias("component_id"))
    named = roots.join(joined, "root")
    names = smallest.join(named, "node", "left").select(
        "node", F.coalesce("root", "node").alias("node_id"), F.coalesce("component_id", "own").alias("component_id"))
    # Written, so that the last join reads both sides from exchanges of its own and can split a hot fingerprint.
    names = checkpoint(names)
    return rows.join(names, rows[node] == names["node"]).select("doc_id", "text_key", "sig", "component_id", "node_id")


def one_of_each_group(docs: DataFrame, plan: SimHashPlan = CORPUS) -> DataFrame:
    """Of each group of near duplicates one row of ``docs``: the one with the smallest ``doc_id``, then text key.

    A row without ``doc_id`` stays only if all of its group have none; of repeated rows one stays.
    """
    groups = near_duplicates(docs, plan).select("doc_id", "text_key", "node_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first")
    chosen = groups.groupBy("node_id").agg(first)
    chosen = chosen.select(F.col("first.doc_id").alias("_d"), F.col("first.text_key").alias("_k"))
    packed = docs.select(
        F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), text_hash(F.col("text")).alias("_key"))
    kept = packed.join(chosen, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")))
    return kept.dropDuplicates(["_key", "_id"]).select("_row.*")
