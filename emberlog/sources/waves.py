"""Log files read in arrival order, a growing part at a time, for those who may stop early."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from emberlog.sources.files import LINES_SCHEMA, PROBE_BYTES, LogFile
from emberlog.sources.ranges import RANGE_BYTES, as_rows, bytes_of, is_gzip, lines_of, open_file

FIRST_BYTES = 64 << 20
GROWTH = 4
# Counts of this many ranges come to the driver per wave; beyond it ranges grow.
_MOST_RANGES = 4096
_RANGES = "source_ord int, source string, uri string, start bigint, stop bigint, last boolean"


def _is_binary(uri: str) -> bool:
    with open_file(uri) as file:
        head = file.read(PROBE_BYTES)
    return head[:2] != b"\x1f\x8b" and b"\0" in head


def count_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges with the number of line ends in ``lines``; null for ranges of binary files."""
    for batch in batches:
        lines = [
            None if _is_binary(r.uri) else sum(piece.count(b"\n") for piece in bytes_of(r.uri, r.start, r.stop))
            for r in batch.itertuples(index=False)
        ]
        kept = batch[["source_ord", "source", "uri", "start", "stop", "last"]]
        yield kept.assign(lines=pd.Series(lines, dtype="Int64", index=batch.index))


def read_numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of ranges whose first one has the ``number``."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            last = r.last or is_gzip(r.uri)  # the first range of a gzip file has all of its lines
            yield from as_rows(r.source_ord, r.source, lines_of(r.uri, r.start, r.stop, 0, r.number, last))


def waves(
    spark: SparkSession, files: list[LogFile], first_bytes: int = FIRST_BYTES, range_bytes: int = RANGE_BYTES
) -> Iterator[tuple[DataFrame, int]]:
    """Lines ``(source_ord, source, line, text)`` of consecutive parts of the files, and how many bytes each part has.

    A part is four times as large as the one before and is cut into ranges read by tasks.  Its line ends are counted when
    it is asked for, its lines are read when they are used.  Gzip files are unpacked by the range they begin with; binary
    files have no lines.
    """
    at, number, budget = 0, 1, first_bytes
    todo = list(enumerate(files))
    while todo:
        step, left, part = max(range_bytes, budget // _MOST_RANGES), budget, []
        while todo and left > 0:
            source_ord, file = todo[0]
            stop = min(file.size, at + min(step, left))
            part.append((source_ord, file.source, file.uri, at, stop, stop == file.size))
            left -= max(stop - at, 1)
            at = stop
            if stop == file.size:
                todo, at = todo[1:], 0
        ranges = spark.createDataFrame(part, _RANGES).repartition(len(part), "source_ord", "start")
        counted = ranges.mapInPandas(count_lines, f"{_RANGES}, lines bigint").select("source_ord", "start", "lines").collect()
        lines = {(r.source_ord, r.start): r.lines for r in counted}
        numbered = []
        for source_ord, source, uri, start, stop, last in part:
            number = number if start else 1
            if (n := lines[source_ord, start]) is not None:
                numbered.append((source_ord, source, uri, start, stop, last, number))
                number += n
        size = sum(stop - start for _, _, _, start, stop, _ in part)
        rows = spark.createDataFrame(numbered, f"{_RANGES}, number bigint")
        yield rows.repartition(max(len(numbered), 1), "source_ord", "start").mapInPandas(read_numbered, LINES_SCHEMA), size
        budget *= GROWTH
