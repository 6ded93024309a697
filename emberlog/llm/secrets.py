"""Secrets in texts: known shapes, and strings that a tokenizer finds hard to say.

Words and names are covered by few long tokens of a public vocabulary; random strings need a token for every
one or two characters.  Strings of key characters with a low number of characters per token are reported, unless
they are digests of a known length, numbers, or identifiers in upper and lower case.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
MIN_CHARS = 20
MAX_CHARS_PER_TOKEN = 2.0

# The base shapes in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "dense")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_NEEDS = ("password", "passwd", "secret", "token", "api")
_ASSIGN_VALUE = 6
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_STRING = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
# Lengths of common digests in hexadecimal digits, and the shape of a UUID.
_DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
# What an identifier is made of: words in one case or capitalised, and numbers; on average they are this long at least.
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_PART_CHARS = 4

_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):
    """The vocabulary of a rank file, read once per worker."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _ENCODINGS[path] = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def is_known(text: str) -> bool:
    """Digests, UUIDs, numbers, runs of a character or two and identifiers in both cases: not secret, however they are tokenized."""
    if _HEX_ONLY.fullmatch(text) and len(text) in _DIGEST_LENGTHS or _UUID.fullmatch(text):
        return True
    upper, lower = any(map(str.isupper, text)), any(map(str.islower, text))
    if not upper and not lower or len(set(text)) <= 2:
        return True
    # Random letters of both cases change their kind all the time; names seldom do.  Of letters in one case only the
    # tokens tell.
    return upper and lower and len(text) >= _PART_CHARS * len(_PART.findall(text))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the base shapes, in no order."""
    found = []
    lower = text.lower()
    if any(word in lower for word in _ASSIGN_NEEDS):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return found


def dense_spans(text: str, encoding, most: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, str, int]]:
    """Strings with few characters per token."""
    found = []
    for m in _STRING.finditer(text):
        if not is_known(m[0]) and len(m[0]) < most * len(encoding.encode_ordinary(m[0])):
            found.append((m.start(), "dense", m.end()))
    return found


def spans_of(text: str, encoding, most: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, str, int]]:
    """All spans by start, then kind; dense strings that touch a base span add nothing and are left out."""
    base = sorted(base_spans(text))
    starts, ends = [], []  # stretches that base spans cover, in order and apart
    for start, _, end in base:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)

    def touches(start: int, end: int) -> bool:
        before = bisect_left(starts, end) - 1
        return before >= 0 and ends[before] > start

    more = [d for d in dense_spans(text, encoding, most) if not touches(d[0], d[2])]
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[1])))


def find_secrets(docs: DataFrame, path: str | None = None, most: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """``(doc_id, spans)`` per row of ``docs (doc_id, text)``; a span is ``kind``, ``start`` and ``end`` in code points.

    ``path`` is a rank file that every worker can open, by default the public one installed with them.  ``assign``,
    ``access`` and ``hex`` are shapes; ``dense`` strings have fewer than ``most`` characters per token.  A null text
    is empty.  Rows are searched one by one, whole, and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path
        if where is None:
            import public_tokenizers
            where = public_tokenizers.path(RANKS)
        encoding = _encoding(where)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [
                [{"kind": k, "start": s, "end": e} for s, k, e in spans_of(t.as_py() or "", encoding, most)]
                for t in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return known.mapInArrow(run, "doc_id bigint, spans array<struct<kind: string, start: int, end: int>>")
