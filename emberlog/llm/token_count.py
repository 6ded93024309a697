"""Tokens counted by byte-pair merging, without making tokens.

A piece of text starts as a linked list of bytes.  A heap holds adjacent pairs that can merge, by rank and then
position; the lowest is popped and merged, and the pairs around it are pushed, until none is left.  The count is the
symbols at the start minus the merges.  Symbols are numbers given in order of first use, so the vocabulary's own
identifiers are neither read nor emitted.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush
from typing import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
# Counts of pieces seen so far are kept up to this number per worker, then forgotten; a lost count is made again.
_KEPT = 400_000
# Fixed value: how the tokenizer splits text into pieces before merging.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same split for the built-in matcher, which is twice as fast but has no classes of letters and numbers.  They
# agree unless the text has a character of _OTHER: odd white space, numbers that are no digits, or anything
# beyond the Latin letters.
_LATIN = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHER = re.compile("[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")


def _printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself where printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """Merges of a byte-level tokenizer file: pair of symbols -> (rank, symbol)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        form = spec["pre_tokenizer"] or {}
        if form.get("type") != "ByteLevel" or form.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only byte-level tokenizers without normalizer and added space are counted")
        byte_of = _printable_bytes()
        # Symbols 0 to 255 are the bytes.
        symbols: dict[str, int] = dict(byte_of)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = symbols.setdefault(left + right, len(symbols))
            self.merges[symbols[left], symbols[right]] = (rank, made)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(_PIECES)
        self.kept: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Tokens of one piece."""
        n, merges = len(piece), self.merges
        if n < 2:
            return n
        symbol, before, after = list(piece), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*found, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (found := merges.get((symbol[i], symbol[i + 1])))]
        heapify(heap)
        count = n
        while heap:
            _, made, i, left, right = heappop(heap)
            j = after[i]
            # A pair that a merge has changed since is out of date.
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            symbol[i], symbol[j] = made, -1
            count -= 1
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if found := merges.get((made, symbol[k])):
                    heappush(heap, (*found, i, made, symbol[k]))
            if h >= 0 and (found := merges.get((symbol[h], made))):
                heappush(heap, (*found, h, symbol[h], made))
        return count

    def _count_plain(self, text: str) -> int:
        kept, pieces = self.kept, (self.pieces if _OTHER.search(text) else _LATIN).findall(text)
        counts = list(map(kept.get, pieces))
        if None in counts:
            for i, piece in enumerate(pieces):
                if counts[i] is None:
                    n = counts[i] = kept.get(piece) or self.merged(piece.encode("utf-8"))
                    if len(kept) >= _KEPT:
                        kept.clear()
                    if len(piece) <= 64:
                        kept[piece] = n
        return sum(counts)

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string inside it is one token."""
        if self.special is None:
            return self._count_plain(text)
        parts = self.special.split(text)
        return sum(map(self._count_plain, parts)) + len(parts) - 1


_TABLES: dict[str, MergeTable] = {}


def merge_table(path: str) -> MergeTable:
    """The table of a file, read once per worker."""
    if path not in _TABLES:
        _TABLES[path] = MergeTable(path)
    return _TABLES[path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row of ``docs (doc_id, text)``, as the file's own library counts.

    ``path`` is the tokenizer file, which every worker must be able to open; by default the public file that is
    installed with them.  Special tokens are neither added nor cut off; a null text is empty and has no tokens.  Rows are
    counted one by one, so repeated rows and rows without an id are rows like any other, and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path is None:
            import public_tokenizers
            where = public_tokenizers.path(TOKENIZER)
        else:
            where = path
        table = merge_table(where)
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                sizes.append(len(text.encode("utf-8")))
                counts.append(table.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return known.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
