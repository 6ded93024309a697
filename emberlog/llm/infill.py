"""Fill-in-the-middle over texts kept as seekable compressed frames.

A text is cut into frames of a fixed number of code points, each compressed on its own, with the number of units (runs of
ASCII letters, and single other characters) before it.  Where a cut after so many units lies is found by the
cumulative counts, and only the frame it falls into is decompressed.  Rearranged texts, digests and the way back are streams of
frames in order, so that at most one frame of plain text is held beyond the row itself.
"""

from __future__ import annotations

import hashlib
import re
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME_CHARS = 1 << 16
_LEVEL = 1
# The markers, the names of the forms, and the shares in percent of plain and of spm texts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_PLAIN_FROM, _SPM_BELOW = 90, 20

_MARKER = re.compile(f"{PREFIX}|{SUFFIX}|{MIDDLE}")
_FRAME = T.StructType([
    T.StructField("first_unit", T.LongType()), T.StructField("n_units", T.LongType()), T.StructField("first_char", T.LongType()),
    T.StructField("n_chars", T.LongType()), T.StructField("in_run", T.BooleanType()), T.StructField("data", T.BinaryType())])
_FRAME_ARROW = pa.struct([
    ("first_unit", pa.int64()), ("n_units", pa.int64()), ("first_char", pa.int64()), ("n_chars", pa.int64()),
    ("in_run", pa.bool_()), ("data", pa.binary())])


def _unit_starts(text: str, in_run: bool) -> tuple[np.ndarray, bool]:
    """Places where a unit starts, and whether the text ends in a letter; ``in_run`` if a letter stands before it."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    folded = points | 32
    letter = (folded >= 97) & (folded <= 122)
    inside = np.empty_like(letter)
    inside[1:] = letter[:-1]
    inside[:1] = in_run
    return np.flatnonzero(~(letter & inside)), bool(letter[-1]) if len(letter) else in_run


class Frames:
    """A text as frames in order, ``dict`` rows of the stored table."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.n_units = rows[-1]["first_unit"] + rows[-1]["n_units"] if rows else 0
        self.n_chars = rows[-1]["first_char"] + rows[-1]["n_chars"] if rows else 0

    @classmethod
    def pack(cls, pieces: Iterable[str], size: int = FRAME_CHARS) -> Frames:
        """Frames of ``size`` code points, the last one shorter, from pieces of any length."""
        packer, rows = zstandard.ZstdCompressor(level=_LEVEL), []
        units = chars = 0
        in_run, held, n_held = False, [], 0

        def close(text: str) -> None:
            nonlocal units, chars, in_run
            starts, ends_in_run = _unit_starts(text, in_run)
            rows.append({"first_unit": units, "n_units": len(starts), "first_char": chars, "n_chars": len(text), "in_run": in_run,
                         "data": packer.compress(text.encode("utf-8", "replace"))})
            units, chars, in_run = units + len(starts), chars + len(text), ends_in_run

        for piece in pieces:
            at = 0
            while at < len(piece):
                part = piece[at : at + size - n_held]
                at += len(part)
                held.append(part)
                n_held += len(part)
                if n_held == size:
                    close("".join(held))
                    held, n_held = [], 0
        if n_held:
            close("".join(held))
        return cls(rows)

    def _plain(self, row: dict) -> str:
        return zstandard.ZstdDecompressor().decompress(row["data"]).decode("utf-8")

    def char_after(self, units: int) -> int:
        """Code points in the first ``units`` units; one frame is decompressed."""
        if units >= self.n_units:
            return self.n_chars
        ends = np.array([r["first_unit"] + r["n_units"] for r in self.rows])
        row = self.rows[int(np.searchsorted(ends, units, side="right"))]
        starts, _ = _unit_starts(self._plain(row), row["in_run"])
        return row["first_char"] + int(starts[units - row["first_unit"]])

    def stream(self, start: int = 0, stop: int | None = None) -> Iterator[str]:
        """The text between two places, a frame at a time."""
        stop = self.n_chars if stop is None else stop
        for row in self.rows:
            low, high = max(start - row["first_char"], 0), min(stop - row["first_char"], row["n_chars"])
            if low < high:
                yield self._plain(row)[low:high]

    def find(self, marker: re.Pattern, start: int = 0) -> int:
        """Where the first marker of three code points at or after ``start`` begins, or -1."""
        tail, at = "", start
        for piece in self.stream(start):
            seen = tail + piece
            if hit := marker.search(seen):
                return at - len(tail) + hit.start()
            at += len(piece)
            tail = seen[-2:]
        return -1


def choice(doc_id: int | None, n_units: int, blocked: bool) -> tuple[str, int, int]:
    """Form, and the units after which prefix and middle end; an id that is null counts as empty."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    cuts = sorted((h1 % (n_units + 1), h2 % (n_units + 1)))
    if blocked or h3 % 100 >= _PLAIN_FROM:
        return PLAIN, *cuts
    return (SPM if h4 % 100 < _SPM_BELOW else PSM), *cuts


def rearranged(text: Frames, form: str, prefix_end: int, middle_end: int) -> Iterator[str]:
    """The output of a form as a stream; prefix and middle end after so many code points."""
    prefix, middle, suffix = (0, prefix_end), (prefix_end, middle_end), (middle_end, text.n_chars)
    if form == PLAIN:
        yield from text.stream()
        return
    order = [(PREFIX, prefix), (SUFFIX, suffix)] if form == PSM else [(SUFFIX, suffix), (PREFIX, prefix)]
    for mark, (start, stop) in [*order, (MIDDLE, middle)]:
        yield mark
        yield from text.stream(start, stop)


def restored(output: Frames, form: str) -> Iterator[str]:
    """The text back from an output and its form alone: its parts lie between the markers, which no part contains."""
    if form == PLAIN:
        yield from output.stream()
        return
    second = output.find(re.compile(SUFFIX if form == PSM else PREFIX), 3)
    third = output.find(re.compile(MIDDLE), second + 3)
    first_part, second_part, middle = (3, second), (second + 3, third), (third + 3, output.n_chars)
    for part in (first_part, middle, second_part) if form == PSM else (second_part, middle, first_part):
        yield from output.stream(*part)


def sha256_of(pieces: Iterable[str]) -> str:
    """Lowercase hex of a stream's UTF-8."""
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece.encode("utf-8", "replace"))
    return digest.hexdigest()


def framed(docs: DataFrame, frame_chars: int = FRAME_CHARS) -> DataFrame:
    """Every row of ``docs`` without its ``text``, packed in ``_row``, and the text as ``frames``; null counts as empty, without a frame.

    ``frames`` is an array of ``(first_unit, n_units, first_char, n_chars, in_run, data)``, meant to be written: a frame
    is read without those before it.  Nothing is shuffled, and a row depends on no other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = [Frames.pack([t] if t else [], frame_chars).rows for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(frames, pa.list_(_FRAME_ARROW))], ["_row", "frames"])

    packed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), F.col("text").alias("_text"))
    schema = T.StructType([packed.schema["_row"], T.StructField("frames", T.ArrayType(_FRAME))])
    return packed.mapInArrow(run, schema)


def infilled(texts: DataFrame, frame_chars: int = FRAME_CHARS) -> DataFrame:
    """Rows of ``framed`` with ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and the ``output`` as frames.

    A text is plain if it is empty, contains a marker or its id's hash says so; it has no cuts then (null).  The
    choice depends on ``doc_id`` alone, so repeated ids are cut alike, each in its own text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_row").field("doc_id").to_pylist()
            found = []
            for doc_id, rows in zip(ids, batch.column("frames")):
                text = Frames(rows.as_py() or [])
                form, first, second = choice(doc_id, text.n_units, not text.n_chars or text.find(_MARKER) >= 0)
                prefix, middle = text.char_after(first), text.char_after(second)
                output = Frames.pack(rearranged(text, form, prefix, middle), frame_chars)
                cuts = (None, None) if form == PLAIN else (prefix, middle - prefix)
                found.append((text.n_units, form, *cuts, output.rows))
            columns = list(zip(*found)) if found else [[]] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(_FRAME_ARROW)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), *(pa.array(list(c), t) for c, t in zip(columns, types))],
                ["_row", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = T.StructType([
        texts.schema["_row"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.ArrayType(_FRAME))])
    return texts.select("_row", "frames").mapInArrow(run, schema)


def with_digests(outputs: DataFrame) -> DataFrame:
    """Rows of ``infilled`` with ``output_sha256`` and, of the text rebuilt from output and form, ``restored_sha256`` instead of the output."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, back = [], []
            for form, rows in zip(batch.column("form").to_pylist(), batch.column("output")):
                output = Frames(rows.as_py())
                shas.append(sha256_of(output.stream()))
                back.append(sha256_of(restored(output, form)))
            kept = ["_row", "n", "form", "prefix_chars", "middle_chars"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(shas, pa.string()), pa.array(back, pa.string())],
                [*kept, "output_sha256", "restored_sha256"])

    schema = T.StructType([
        *(f for f in outputs.schema.fields if f.name != "output"),
        T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())])
    return outputs.mapInArrow(run, schema)
