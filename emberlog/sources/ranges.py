"""Byte ranges of log files, read by the tasks that need them.

A line belongs to the range its end lies in, and is read from its beginning wherever that is, so ranges may cut a file
anywhere.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import pandas as pd

RANGE_BYTES = 16 << 20
_PIECE_BYTES = 1 << 20
# The beginning of a line is looked for in as many bytes before, then in ever more.
_BACK_BYTES = 1 << 12
_GZIP = b"\x1f\x8b"


def is_local(path: str) -> bool:
    return "://" not in path and not path.startswith("file:")


def file_system(path: str):
    import pyarrow.fs as pafs

    if is_local(path) or path.startswith("file:"):
        return pafs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def open_file(path: str):
    fs, plain = file_system(path)
    return fs.open_input_file(plain)


def is_gzip(path: str) -> bool:
    with open_file(path) as file:
        return file.read(2) == _GZIP


def bytes_of(path: str, start: int, stop: int) -> Iterator[bytes]:
    """Bytes of a range.  A compressed file is unpacked whole by the range it begins with; its other ranges are empty."""
    with open_file(path) as file:
        if file.read(2) == _GZIP:
            if start == 0:
                yield from _unpacked(file)
            return
        file.seek(start)
        left = stop - start
        while left > 0 and (piece := file.read(min(_PIECE_BYTES, left))):
            left -= len(piece)
            yield piece


def _unpacked(file) -> Iterator[bytes]:
    file.seek(0)
    decoder = zlib.decompressobj(31)
    while piece := file.read(_PIECE_BYTES):
        while piece:
            yield decoder.decompress(piece, _PIECE_BYTES)
            piece = decoder.unconsumed_tail
            if decoder.eof:
                piece, decoder = decoder.unused_data, zlib.decompressobj(31)
    yield decoder.flush()


def line_start(path: str, at: int, floor: int) -> int:
    """Where the line that goes on at ``at`` begins, not before ``floor``."""
    if at <= floor:
        return at
    with open_file(path) as file:
        if file.read(2) == _GZIP:
            return at
        step = _BACK_BYTES
        while at > floor:
            begin = max(floor, at - step)
            file.seek(begin)
            last = file.read(at - begin).rfind(b"\n")
            if last >= 0:
                return begin + last + 1
            at, step = begin, min(2 * step, _PIECE_BYTES)
    return floor


def lines_of(path: str, start: int, stop: int, floor: int, number: int, last: bool = False) -> Iterator[tuple[int, list[str]]]:
    """Lines that end in a range, some at a time with the number of the first.

    ``floor`` is where the file was taken up: no line begins before it.  With ``last`` what follows the last line end is a
    line as well.
    """
    held: list[bytes] = []
    for piece in bytes_of(path, line_start(path, start, floor), stop):
        first, newline, rest = piece.partition(b"\n")
        held.append(first)
        if not newline:
            continue
        some = [b"".join(held), *rest.split(b"\n")]
        held = [some.pop()]
        yield number, [_text(t) for t in some]
        number += len(some)
    if last and (rest := b"".join(held)):
        yield number, [_text(rest)]


def _text(line: bytes) -> str:
    return line.removesuffix(b"\r").decode("utf-8", "replace")


def as_rows(source_ord: int, source: str, found: Iterator[tuple[int, list[str]]]) -> Iterator[pd.DataFrame]:
    for number, texts in found:
        yield pd.DataFrame({"source_ord": source_ord, "source": source, "line": range(number, number + len(texts)), "text": texts})
