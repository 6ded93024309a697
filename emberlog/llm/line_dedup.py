"""Repeated lines found by hash; documents get a compressed bitmap of the lines they keep.

Every line long enough becomes ``(hash, doc_id, text_key, position)``.  Rows are range-partitioned and sorted by all
of it, so each task streams whole stretches of hashes in order of document and position: the first document of
a hash holds its first occurrence, and every line of a later document goes.  The ranges cut within a hash too, so
a line that fills a third of all rows is spread over many tasks.  Such a hash is open where a task starts in the
middle of it; tasks report the document they begin and end with, two rows each, and joining these settles
the open lines.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import checkpoint, text_hash

MIN_CHARS = 10
# What is stripped from both ends of a line.
_SPACE = " \t\n\v\f\r"
_SPACE_BYTES = _SPACE.encode()
_ROW = "hi bigint, lo bigint, last boolean, doc_id bigint, text_key binary, pos int"


def _line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            rows, pos, digests = [], [], []

            def flush() -> pa.RecordBatch:
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                at = pa.array(rows, pa.int64())
                doc = ids.take(at)
                out = pa.RecordBatch.from_arrays(
                    [pa.array(halves[:, 0]), pa.array(halves[:, 1]), doc.is_null(), doc, keys.take(at), pa.array(pos, pa.int32())],
                    ["hi", "lo", "last", "doc_id", "text_key", "pos"])
                rows.clear(), pos.clear(), digests.clear()
                return out

            for i, value in enumerate(batch.column("text")):
                text = value.as_py()
                for p, line in enumerate(text.encode().split(b"\n")) if text else ():
                    line = line.strip(_SPACE_BYTES)
                    # Bytes bound characters from above, and by a quarter from below.
                    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode()) < min_chars):
                        continue
                    rows.append(i), pos.append(p), digests.append(hashlib.blake2b(line.lower(), digest_size=16).digest())
                    if len(rows) >= 1 << 16:
                        yield flush()
            if rows:
                yield flush()

    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_hash(F.col("text")).alias("text_key"), "text")
    return known.mapInArrow(run, _ROW)


def _streamed(lines: DataFrame) -> DataFrame:
    """Lines to drop (``kind`` 0), open ones (1), and the first and last document of each task's ends (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, first = None, None  # hash being streamed, its first document in this task
        opening = None            # the hash this task began with
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = np.stack([batch.column("hi").to_numpy(), batch.column("lo").to_numpy()], axis=1)
            ids = batch.column("doc_id")
            docs = np.where(ids.is_null(), 0, ids.fill_null(0).to_numpy())
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero((np.diff(hashes, axis=0) != 0).any(axis=1)) + 1])
            runs = np.repeat(starts, np.diff(np.concatenate([starts, [len(hashes)]])))
            first_doc, first_null = docs[runs], nulls[runs]
            head = tuple(hashes[0])
            if here == head:
                at_head = runs == 0
                first_doc[at_head], first_null[at_head] = first[0], first[1]
            if opening is None:
                opening = head
                yield _mark(head, (int(docs[0]), bool(nulls[0])))
            later = (docs != first_doc) | (nulls != first_null)
            is_open = (hashes == np.array(opening)).all(axis=1)
            # In the hash a task begins with, even its first document may come after another task's.
            keep = np.flatnonzero(later | is_open)
            if len(keep):
                part = batch.take(pa.array(keep))
                kind = pa.array(np.where(is_open[keep], 1, 0).astype(np.int32))
                yield pa.RecordBatch.from_arrays([kind, *(part.column(c) for c in ("hi", "lo", "last", "doc_id", "text_key", "pos"))], _NAMES)
            here, first = tuple(hashes[-1]), (int(first_doc[-1]), bool(first_null[-1]))
        if here is not None:
            yield _mark(here, first)

    return lines.mapInArrow(run, f"kind int, {_ROW}")


_NAMES = ["kind", "hi", "lo", "last", "doc_id", "text_key", "pos"]


def _mark(key: tuple, first: tuple[int, bool]) -> pa.RecordBatch:
    doc = None if first[1] else first[0]
    return pa.RecordBatch.from_arrays(
        [pa.array([2], pa.int32()), pa.array([int(key[0])]), pa.array([int(key[1])]), pa.array([first[1]]),
         pa.array([doc], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.int32())], _NAMES)


def _packed(positions: np.ndarray) -> bytes:
    """Bit i set: line i goes.  Long documents with few repeats compress to a few bytes."""
    bits = np.zeros(int(positions.max()) + 1, np.uint8)
    bits[positions] = 1
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def dropped_positions(bitmap: bytes | None) -> np.ndarray:
    """Positions of the lines that go, of one document's bitmap; none for a document without one."""
    if bitmap is None:
        return np.empty(0, np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little"))


def line_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, text_key, n_dropped, bitmap)`` of the documents that lose lines; all others keep every line.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased.  A key of at least
    ``min_chars`` characters that occurs in more than one document loses its lines in all of them but the
    one with the smallest ``doc_id``.  Rows with one ``doc_id`` are one document; rows without one are one
    document after all others.  A null text is one empty line.  Hashes have 128 bits.
    """
    lines = _line_rows(docs, min_chars)
    # ``last`` sorts the document without an id behind the others.
    order = ["hi", "lo", "last", "doc_id", "text_key", "pos"]
    found = checkpoint(_streamed(lines.repartitionByRange(*order).sortWithinPartitions(*order)))
    marks = found.filter("kind = 2").groupBy("hi", "lo").agg(F.min(F.struct("last", "doc_id")).alias("first"))
    marks = marks.select(F.col("hi").alias("_h"), F.col("lo").alias("_l"), "first")
    # Two marks per task at most: their number follows the tasks, not the lines.
    opened = found.filter("kind = 1").join(F.broadcast(marks), F.expr("hi = _h AND lo = _l"))
    late = opened.filter(~F.struct("last", "doc_id").eqNullSafe(F.col("first")))
    gone = found.filter("kind = 0").select("doc_id", "text_key", "pos").unionByName(late.select("doc_id", "text_key", "pos"))

    def pack(column: pd.Series) -> pd.Series:
        return column.map(lambda p: _packed(np.asarray(p)))

    packed = F.pandas_udf(pack, "binary")
    # As many positions as the document has lines, at most.
    per_doc = gone.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("_pos"))
    return per_doc.select("doc_id", "text_key", F.size("_pos").cast("bigint").alias("n_dropped"), packed("_pos").alias("bitmap"))


def kept_text(text: str | None, bitmap: bytes | None) -> str:
    lines = (text or "").split("\n")
    gone = set(dropped_positions(bitmap).tolist())
    return "\n".join(line for i, line in enumerate(lines) if i not in gone) if gone else (text or "")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Every row of ``docs`` packed in ``_row``, with its ``bitmap`` and ``n_dropped`` (null: all lines stay)."""
    packed = docs.select(
        F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), text_hash(F.col("text")).alias("_key"))
    bits = bitmaps.select(F.col("doc_id").alias("_bid"), F.col("text_key").alias("_bkey"), "bitmap", "n_dropped")
    same = (F.col("_key") == F.col("_bkey")) & F.col("_id").eqNullSafe(F.col("_bid"))
    return packed.join(bits, same, "left").select("_row", "bitmap", "n_dropped")


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines gone that ``line_bitmaps`` drops; ``n_chars``, if there is one, counts what is left."""

    def cut(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
        return pd.Series([t if b is None else kept_text(t, b) for t, b in zip(texts, bitmaps)], dtype=object)

    rows = with_bitmaps(docs, line_bitmaps(docs, min_chars)).withColumn(
        "_text", F.pandas_udf(cut, "string")(F.col("_row.text"), F.col("bitmap")))
    fields = {f.name: F.col("_row").getField(f.name) for f in docs.schema.fields}
    fields["text"] = F.col("_text")
    if "n_chars" in fields:
        left = F.char_length("_text").cast(docs.schema["n_chars"].dataType)
        fields["n_chars"] = F.when(F.col("bitmap").isNull(), fields["n_chars"]).otherwise(left)
    return rows.select(*[column.alias(name) for name, column in fields.items()])
