"""Document fingerprints by MinHash.

A text's shingles are hashed to 32 bits; every slot of the fingerprint is the smallest value that one universal hash
function ``(a * x + b) >> 32`` gives them.  The share of equal slots of two fingerprints estimates the Jaccard
similarity of their shingles.  Runs of slots are bands: texts that are alike share a band, bands are joined in
Spark, and pairs are verified by the Jaccard similarity itself.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import checkpoint, components, group_starts, shingles_of, text_hash, whole_groups, words_of

SHINGLE = 5
SLOTS = 64
BAND_ROWS = 4
SIMILAR = 0.8
_SEED = 1
_BASE = 0x100000001B3
_EMPTY = np.uint16(0xFFFF)
_CHUNK = 2048
# Digests sampled per chunk where an id fills chunks by itself.
_SAMPLED = 64


def _functions(slots: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    odd = rng.integers(0, 1 << 63, slots, np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 1 << 63, slots, np.uint64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as the longest text so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(2 * len(self.up), n, 1 << 16)
            for name, factor in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def shingle_hashes(text: str, n: int = SHINGLE) -> np.ndarray:
    """One 32-bit hash per shingle of ``n`` words, all at once: differences of a running polynomial."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _POWERS.upto(len(raw) + 1)
    running = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=running[1:])
    blanks = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(raw)]])
    if len(starts) > n:
        starts, ends = starts[: len(starts) - n + 1], ends[n - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = (running[ends] - running[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h >> np.uint64(32)


def signature(text: str | None, slots: int = SLOTS, shingle: int = SHINGLE) -> np.ndarray:
    """Low 16 bits of each slot's minimum; a text without words has all bits set."""
    hashes = shingle_hashes(text or "", shingle)
    if not len(hashes):
        return np.full(slots, _EMPTY)
    a, b = _functions(slots)
    low = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        values = hashes[at : at + _CHUNK, None] * a
        values += b
        np.minimum(low, values.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint16)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float((x == y).mean())


def signatures(docs: DataFrame, slots: int = SLOTS, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_key, sig)`` per row of ``docs (doc_id, text)``; 16 bits a slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [signature(t.as_py(), slots, shingle).astype(">u2").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sigs, pa.binary())], ["doc_id", "text_key", "sig"])

    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(F.col("text")).alias("text_key"), "text")
    return known.mapInArrow(run, "doc_id bigint, text_key binary, sig binary")


def _pairs_apart(banded: DataFrame) -> DataFrame:
    """``(a, b)``: all pairs of ``(text_key, band, root)`` with one band and different roots, one whole bucket in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "band", _CHUNK):
            keys, roots = batch.column("text_key"), batch.column("root").dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(group_starts(batch.column("band")))
            for s, e in zip(starts, np.append(starts[1:], batch.num_rows)):
                for i in range(s, e - 1):
                    others = i + 1 + np.flatnonzero(roots[i + 1 : e] != roots[i])
                    if len(others):
                        mine = keys.take(pa.array(np.full(len(others), i)))
                        yield pa.RecordBatch.from_arrays([mine, keys.take(pa.array(others))], ["a", "b"])

    ordered = banded.select("band", "text_key", "root").repartition("band").sortWithinPartitions("band", "text_key")
    return ordered.mapInArrow(run, "a binary, b binary")


def similar_texts(
    docs: DataFrame, similar: float = SIMILAR, slots: int = SLOTS, band_rows: int = BAND_ROWS, shingle: int = SHINGLE
) -> DataFrame:
    """``(doc_id, text_key, class_id)`` per row: texts linked by a Jaccard similarity of ``similar`` or more.

    ``class_id`` is the smallest ``doc_id`` of the class.  Equal texts are one text.  All texts of a band's bucket
    are first compared with its smallest text key, which settles a bucket of copies at a row per text.  In buckets that
    still hold texts of several classes all pairs of different classes are compared then, each pair once, so a bucket
    of boilerplate costs the pairs of its texts.  With 16 bands of four slots a pair at 0.8 meets in 6 bands and more
    nearly always.  A null text is empty, and texts without words are alike.
    """
    rows = checkpoint(signatures(docs, slots, shingle))
    texts = rows.groupBy("text_key").agg(F.min("sig").alias("sig"), F.min("doc_id").alias("doc_id"))
    width = 2 * band_rows
    bands = [F.concat(F.lit(bytes([i])), F.substring("sig", 1 + i * width, width)) for i in range(slots // band_rows)]
    banded = texts.select("text_key", F.explode(F.array(*bands)).alias("band"))
    heads = banded.groupBy("band").agg(F.min("text_key").alias("b"), F.count("*").alias("n")).filter("n > 1")
    pairs = banded.join(heads, "band").filter("text_key <> b").select(F.col("text_key").alias("a"), "b").distinct()
    pairs = checkpoint(pairs)

    needed = pairs.select(F.col("a").alias("_k")).union(pairs.select("b")).distinct()
    needed = needed.join(texts.select(F.col("text_key").alias("_k"), F.col("doc_id").alias("_d")), "_k")
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_hash(F.col("text")).alias("text_key"))
    bodies = own.join(needed, (F.col("text_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    bodies = checkpoint(bodies.select("text_key", "text").dropDuplicates(["text_key"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = (set(shingles_of(words_of(t.as_py()), shingle)) for t in (x, y))
                keep.append(len(p & q) >= similar * len(p | q))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(some: DataFrame) -> DataFrame:
        sides = some.join(bodies.toDF("a", "x"), "a").join(bodies.toDF("b", "y"), "b")
        return sides.mapInArrow(run, "a binary, b binary")

    links = checkpoint(verified(pairs))
    # A link to the head that failed settles nothing: what is still apart in a bucket is compared pair by pair.
    place = components(links).toDF("text_key", "root")
    placed = checkpoint(banded.join(place, "text_key", "left").withColumn("root", F.coalesce("root", "text_key")))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    apart = checkpoint(_pairs_apart(placed.join(mixed.select("band"), "band")).distinct())
    roots = components(links.unionByName(verified(apart)))
    first = texts.select(F.col("text_key").alias("node"), "doc_id")
    classes = roots.join(first, "node").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = roots.join(classes, "root").select("node", "class_id")
    names = first.join(named, "node", "left").select("node", F.coalesce("class_id", "doc_id").alias("class_id"))
    return rows.join(names, rows["text_key"] == names["node"]).select("doc_id", "text_key", "class_id")


def edited_text(text: str, following: str) -> str:
    """The last third replaced by as much of the start of another text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _place(doc_id: int | None, key: bytes) -> tuple[bool, int, bytes]:
    """Where a row stands: ids descending, rows without one last, ties by the text's digest."""
    return (True, 0, key) if doc_id is None else (False, -doc_id, key)


def _bounds(known: DataFrame, chunks: int) -> list[tuple[bool, int, bytes]]:
    """Places that cut the rows into about ``chunks`` chunks, in order; one that comes twice is a text that fills chunks alone.

    Quantiles of the ids, from a sketch.  An id that is several of them, and rows without an id where there are many, are cut
    further at quantiles of a sample of their texts' digests, some dozens per chunk.
    """
    total, nameless = known.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    steps = [i / chunks for i in range(1, chunks)]
    # A quantile off by half a chunk does no harm: chunks need not be equal.
    marks = Counter(int(q) for q in known.select("doc_id").approxQuantile("doc_id", steps, 1 / (4 * chunks))) if steps else Counter()
    out = [_place(i, b"") for i in marks]
    parts = {i: n for i, n in marks.items() if n > 1}
    if nameless * chunks > total:
        out.append(_place(None, b""))
        parts[None] = nameless * chunks // total
    if parts:
        crowded = F.col("doc_id").isin([i for i in parts if i is not None]) | F.col("doc_id").isNull()
        some = known.filter(crowded).select("doc_id", "key").sample(min(1.0, _SAMPLED * chunks / total), _SEED)
        keys: dict[int | None, list[bytes]] = {}
        for row in some.collect():
            keys.setdefault(row.doc_id, []).append(bytes(row.key))
        for doc_id, n in parts.items():
            found = sorted(keys.get(doc_id, []))
            out += [_place(doc_id, found[len(found) * j // n]) for j in range(1, n) if found]
    return sorted(out)


def _chunk(bounds: list[tuple[bool, int, bytes]]):
    """The chunk of each row; rows of a text that fills several chunks are dealt over these in turn."""
    def of(doc_id: pd.Series, key: pd.Series) -> pd.Series:
        out = []
        for i, k in zip(doc_id, key):
            place = _place(None if pd.isna(i) else int(i), bytes(k))
            low, high = bisect.bisect_left(bounds, place), bisect.bisect_right(bounds, place)
            out.append(high if high - low < 2 else low + 1 + len(out) % (high - low))
        return pd.Series(out, dtype="int32")

    return F.pandas_udf(of, "int")(F.col("doc_id").cast("decimal(20,0)").cast("string"), F.col("key"))


def compare_with_next(docs: DataFrame, slots: int = SLOTS, shingle: int = SHINGLE, chunks: int | None = None) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness, per row of ``docs (doc_id, text)``.

    Rows stand in descending order of ``doc_id``, those without one last, ties by the text's digest; after the last comes
    the first.  A row's edited text ends with the start of the next row's text.  Columns: ``doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next``.  A null text is empty; a single row is its own next.

    The order is cut into chunks at quantiles; an id or a text that fills several chunks is cut as well.  Text is shuffled
    once, each chunk to a task of its own, and streamed in order with one text looked ahead.  The first text of each
    chunk is sent to the chunk before as well.  Only the quantiles and the first id of each chunk come to the driver.
    """
    spark = docs.sparkSession
    chunks = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), text_hash(text).alias("key"))
    bounds = _bounds(known, chunks)
    # Where no id is cut, digests decide no chunk, and the texts need not be read to find the first ids.
    ids = known if any(key for _, _, key in bounds) else known.withColumn("key", F.lit(b""))
    ids = ids.select("doc_id", "key").select("doc_id", _chunk(bounds).alias("chunk"))
    firsts = {r.chunk: r.first for r in ids.groupBy("chunk").agg(F.max("doc_id").alias("first")).collect()}
    order = sorted(firsts)
    if not order:
        return spark.createDataFrame([], _COMPARED)
    heads = spark.createDataFrame([(c, firsts[c], order[i - 1]) for i, c in enumerate(order)], "_chunk int, _first bigint, _to int")

    placed = known.withColumn("chunk", _chunk(bounds))
    first_ids = F.broadcast(heads.select("_first").distinct())  # one row per chunk, as below
    leading = known.join(first_ids, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi").withColumn("chunk", _chunk(bounds))
    leading = leading.join(F.broadcast(heads), (F.col("chunk") == F.col("_chunk")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    ahead = leading.groupBy("_to").agg(F.min_by(F.struct("doc_id", "text"), "key").alias("_row"))
    ahead = ahead.select(F.col("_to").alias("chunk"), F.lit(1).alias("ahead"), "_row.doc_id", "_row.text", F.lit(b"").alias("key"))
    sent = placed.select("chunk", F.lit(0).alias("ahead"), "doc_id", "text", "key").unionByName(ahead)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(doc, text, sig, following, next_sig) -> tuple:
            edited = edited_text(text, following)
            edit_sig = sig if edited == text else signature(edited, slots, shingle)
            return (doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), sig.astype(">u2").tobytes().hex(),
                    edit_sig.astype(">u2").tobytes().hex(), likeness(sig, edit_sig), likeness(sig, next_sig))

        held, at = None, None
        for batch in batches:
            out = []
            for chunk, doc, text in zip(*(batch.column(c) for c in ("chunk", "doc_id", "text"))):
                chunk, doc, text = chunk.as_py(), doc.as_py(), text.as_py()
                if chunk != at:
                    held, at = None, chunk
                sig = signature(text, slots, shingle) if held is None or text != held[1] else held[2]
                if held is not None:
                    out.append(compared(*held, text, sig))
                held = (doc, text, sig)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), _ARROW)], [f.split()[0] for f in _COMPARED.split(", ")])

    ordered = sent.repartitionById(len(bounds) + 1, "chunk").sortWithinPartitions("chunk", "ahead", F.desc_nulls_last("doc_id"), "key")
    return ordered.select("chunk", "doc_id", "text").mapInArrow(run, _COMPARED)


_COMPARED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_ARROW = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
