"""Log files that grow: a stream of their lines.

Spark's file stream reads each file once, so growth is followed by a small source of its own.  Its offsets are byte
positions, one per file, taken from listings; the driver opens no file.  New bytes are cut into ranges of equal
size without looking at them.  Executors count the line ends of each range, a running sum over these counts (one
row per range) says which line a range begins with, and executors read the ranges' lines.  A line belongs to
the range its end lies in, and is read from its beginning wherever that is.
"""

from __future__ import annotations

import glob
import json
import logging
import os
from contextlib import contextmanager
from fnmatch import fnmatchcase
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberlog.sources.ranges import RANGE_BYTES, as_rows, bytes_of, file_system, is_local, lines_of

_COUNT_SCHEMA = "source_ord int, source string, start bigint, stop bigint, lines bigint"
_NUMBERED_SCHEMA = "source_ord int, source string, start bigint, stop bigint, floor bigint, first_line bigint"

# Up to so many ranges each have a task; beyond it a task takes so many small ones at most.
_FEW_RANGES, _MOST_RANGES = 64, 1024

_log = logging.getLogger(__name__)


def _listed(pattern: str) -> dict[str, int]:
    """Size of every file a path or pattern names now."""
    import pyarrow.fs as pafs

    if is_local(pattern):
        found = {}
        for path in [pattern] if not glob.has_magic(pattern) else glob.glob(pattern, recursive=True):
            try:
                if os.path.isfile(path):
                    found[path] = os.path.getsize(path)
            except OSError:
                continue
        return found
    fs, plain = file_system(pattern)
    prefix = pattern[: len(pattern) - len(plain)]
    if not glob.has_magic(plain):
        infos = [fs.get_file_info(plain)]
    else:
        parts = plain.split("/")
        fixed = next(i for i, p in enumerate(parts) if glob.has_magic(p))
        selector = pafs.FileSelector("/".join(parts[:fixed]) or "/", allow_not_found=True, recursive=True)
        infos = [i for i in fs.get_file_info(selector) if fnmatchcase(i.path, plain)]
    return {prefix + i.path: i.size for i in infos if i.type == pafs.FileType.File}


def fair_shares(pending: dict[str, int], budget: int) -> dict[str, int]:
    """Bytes admitted per file: all of a small backlog, and of the others as much each as the budget leaves; at least a byte."""
    shares, left = {}, budget
    for i, (path, n) in enumerate(sorted(pending.items(), key=lambda f: (f[1], f[0]))):
        shares[path] = min(n, max(left // (len(pending) - i), 1))
        left -= shares[path]
    return shares


class _Range(InputPartition):
    def __init__(self, source_ord: int, path: str, start: int, stop: int):
        self.source_ord, self.path, self.start, self.stop = source_ord, path, start, stop

    @property
    def ranges(self) -> list[_Range]:
        return [self]


class _Ranges(InputPartition):
    """Ranges that one task counts, one after the other."""

    def __init__(self, ranges: list[_Range]):
        self.ranges = ranges


def _in_tasks(ranges: list[_Range]) -> list[InputPartition]:
    """A task for each range; where there are many, small ones share a task, which has as many bytes as a large one at most."""
    if len(ranges) <= _FEW_RANGES:
        return ranges
    shared, held = [], RANGE_BYTES
    for r in ranges:
        size = max(r.stop - r.start, 1)
        if held + size > RANGE_BYTES or len(shared[-1]) == _MOST_RANGES:
            shared.append([])
            held = 0
        shared[-1].append(r)
        held += size
    return [_Ranges(some) for some in shared]


class _RangeStream(DataSourceStreamReader):
    """Offsets are ``{path: bytes admitted so far}``.  A file smaller than its offset was cut short and begins anew."""

    def __init__(self, patterns: list[str], from_end: bool, max_bytes: int | None, progress: str | None, range_bytes: int):
        self.patterns, self.from_end, self.max_bytes = patterns, from_end, max_bytes
        self.progress, self.range_bytes = progress, range_bytes
        self.reached: dict | None = None

    def _sizes(self) -> dict[str, int]:
        found: dict[str, int] = {}
        for pattern in self.patterns:
            for path, size in sorted(_listed(pattern).items()):
                found.setdefault(path, size)
        return found

    def _place(self, path: str) -> int:
        return next((i for i, p in enumerate(self.patterns) if p == path or fnmatchcase(path, p)), len(self.patterns))

    def initialOffset(self) -> dict:
        sizes = self._sizes()
        for pattern in self.patterns:
            if not glob.has_magic(pattern) and pattern not in sizes:
                _log.warning("cannot open %s yet", pattern)
        # A file compressed by name does not grow and is read from its beginning.
        self.reached = {p: n if self.from_end and not p.endswith(".gz") else 0 for p, n in sizes.items()}
        return self.reached

    def latestOffset(self) -> dict:
        sizes = self._sizes()
        before = self.reached if self.reached is not None else self._saved()
        if before is None or self.max_bytes is None:
            reached = sizes
        else:
            held = {p: before.get(p, 0) if before.get(p, 0) <= n else 0 for p, n in sizes.items()}
            shares = fair_shares({p: n - held[p] for p, n in sizes.items() if n > held[p]}, self.max_bytes)
            reached = {p: n if p.endswith(".gz") else held[p] + shares.get(p, 0) for p, n in sizes.items()}
        if reached != before:
            self._save(reached)
        self.reached = reached
        return reached

    def _save(self, reached: dict) -> None:
        if not self.progress:
            return
        fs, folder = file_system(self.progress)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/reached.tmp") as out:
            out.write(json.dumps(reached).encode())
        fs.move(f"{folder}/reached.tmp", f"{folder}/reached.json")

    def _saved(self) -> dict | None:
        """What was admitted before a restart, which is never less than what the query's own log holds."""
        if not self.progress:
            return None
        fs, folder = file_system(self.progress)
        try:
            with fs.open_input_stream(f"{folder}/reached.json") as file:
                return json.loads(file.read())
        except OSError:
            return None

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, stop in end.items():
            begin = start.get(path, 0)
            begin = begin if begin <= stop else 0
            if path.endswith(".gz"):
                out += [_Range(self._place(path), path, 0, stop)] if begin == 0 and stop else []
                continue
            for at in range(begin, stop, self.range_bytes):
                out.append(_Range(self._place(path), path, at, min(at + self.range_bytes, stop)))
        return _in_tasks(out)

    def read(self, partition: _Range | _Ranges) -> Iterator[tuple]:
        for r in partition.ranges:
            try:
                lines = sum(piece.count(b"\n") for piece in bytes_of(r.path, r.start, r.stop))
            except FileNotFoundError:
                _log.warning("%s is gone", r.path)
                lines = 0
            yield r.source_ord, r.path, r.start, r.stop, lines


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "emberlog_tail"

    def schema(self) -> str:
        return _COUNT_SCHEMA

    def streamReader(self, schema) -> _RangeStream:
        o = json.loads(self.options["tail"])
        return _RangeStream(o["paths"], o["from_end"], o["max_bytes"], o["progress"], o["range_bytes"])


def _read_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            found = lines_of(row.source, row.start, row.stop, row.floor, row.first_line)
            yield from as_rows(row.source_ord, row.source, found)


class _Numbers(StatefulProcessor):
    """State per file: where its bytes were first taken up, how far they went, and the lines so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "floor bigint, stop bigint, lines bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ranges = pd.concat(list(rows))  # one row per range of bytes
        ranges.columns = ["source_ord", "source", "start", "stop", "lines"]
        held, out = self.at.get(), []
        for r in ranges.sort_values("start").itertuples(index=False):
            if held is None or r.start < held[1]:
                held = (int(r.start), int(r.start), 0)
            if r.lines:
                out.append((r.source_ord, r.source, r.start, r.stop, held[0], held[2] + 1))
            held = (held[0], int(r.stop), held[2] + int(r.lines))
        self.at.update(held)
        frame = pd.DataFrame(out, columns=["source_ord", "source", "start", "stop", "floor", "first_line"])
        yield frame.astype({"source_ord": "int32", "source": "object"})

    def close(self) -> None:
        pass


@contextmanager
def sized_for(spark: SparkSession, max_bytes: int, range_bytes: int = RANGE_BYTES) -> Iterator[int]:
    """A stream started inside shuffles and keeps its state in as many partitions as a batch has full ranges.

    Never more than the session's number.  Every partition of the state is committed in every batch, empty or not, and takes
    longer than the lines of a small batch do.  A query that goes on from a checkpoint keeps the number it began with.
    """
    before = spark.conf.get("spark.sql.shuffle.partitions")
    n = max(1, min(int(before), -(-max_bytes // range_bytes)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def tail_lines(
    spark: SparkSession, paths: list[str], from_end: bool = True, max_bytes: int | None = None, progress: str | None = None,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Stream of lines ``(source_ord, source, line, text)`` appended to files, all files at once.

    ``paths`` may be patterns; they are listed anew for every batch.  Files there at the start are followed from their end, or
    from their beginning, and files that appear later from their beginning.  A line is emitted once its newline is there, and
    lines are numbered from where the tail starts.  A file that shrinks is taken for a new one, numbered from 1.  A
    gzip file is read once from its beginning and must be complete when it appears; where the tail starts at the
    ends of files it is told by its name.  A path that names no file yet is waited for.

    ``max_bytes`` bounds the new bytes of a batch, shared fairly over the files; give ``progress``, a folder of
    the query's own, to bound the first batch after a restart as well.  A query that runs ``availableNow`` admits one such
    share and ends.  Start a query of small batches within ``sized_for``.  A file renamed to another name that a pattern matches is a new file; one cut short and grown
    beyond its old size between two listings is not noticed.
    """
    options = {"paths": list(paths), "from_end": from_end, "max_bytes": max_bytes, "progress": progress, "range_bytes": range_bytes}
    spark.dataSource.register(TailSource)
    ranges = spark.readStream.format("emberlog_tail").option("tail", json.dumps(options)).load()
    numbered = ranges.groupBy("source_ord", "source").transformWithStateInPandas(_Numbers(), _NUMBERED_SCHEMA, "Append", "None")
    return numbered.repartition("source", "start").mapInPandas(
        _read_ranges, "source_ord int, source string, line bigint, text string")
