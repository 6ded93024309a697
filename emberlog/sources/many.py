"""Log files by the million: listed, probed, numbered and read by tasks, with no list of them on the driver.

``read_lines`` scans text with Spark's own reader and is faster where there are some thousands of files; that reader
needs their list on the driver.  Here files are rows from the beginning.
"""

from __future__ import annotations

from fnmatch import fnmatchcase
from glob import has_magic
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.operators.blocks import with_rank
from emberlog.session import scratch_dir
from emberlog.sources.files import LINES_SCHEMA
from emberlog.sources.ranges import RANGE_BYTES, file_system
from emberlog.sources.waves import count_lines, read_numbered

_STEP = "arg int, path string, size bigint, rest array<string>"


def _first_step(arg: int, pattern: str) -> tuple:
    """Where listing a pattern begins: the folder above its first wildcard, and the names wanted below."""
    if not has_magic(pattern):
        return arg, pattern, None, []
    parts = pattern.split("/")
    fixed = next(i for i, p in enumerate(parts) if has_magic(p))
    folder = "/".join(parts[:fixed])
    return arg, folder if folder or not pattern.startswith("/") else "/", None, parts[fixed:]


def _matches(name: str, pattern: str) -> bool:
    return fnmatchcase(name, pattern.replace("[^", "[!"))


def _descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One level of folders: entries that match the next wanted name, a file when no name is left."""
    import pyarrow.fs as pafs

    for batch in batches:
        out = []
        for arg, path, size, rest in zip(batch["arg"], batch["path"], batch["size"], batch["rest"]):
            if not pd.isna(size):
                out.append((arg, path, size, []))
                continue
            fs, plain = file_system(path or ".")
            prefix = path[: len(path) - len(plain)] if path else ""
            if not len(rest):
                info = fs.get_file_info(plain)
                if info.type == pafs.FileType.File:
                    out.append((arg, path, info.size, []))
                continue
            for entry in fs.get_file_info(pafs.FileSelector(plain, allow_not_found=True)):
                if not _matches(entry.base_name, rest[0]):
                    continue
                name = f"{path.rstrip('/')}/{entry.base_name}" if path else entry.base_name
                if len(rest) > 1 and entry.type == pafs.FileType.Directory:
                    out.append((arg, name if not prefix or name.startswith(prefix) else prefix + name, None, list(rest[1:])))
                elif len(rest) == 1 and entry.type == pafs.FileType.File:
                    out.append((arg, name, entry.size, []))
        frame = pd.DataFrame(out, columns=["arg", "path", "size", "rest"])
        yield frame.astype({"arg": "int32", "size": "Int64"})


def list_files(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """``(arg, path, size)`` of the files that paths and patterns name, in no order; missing ones are left out.

    Folders are rows and are listed by tasks, a level of the pattern at a time; every level is spread anew.  ``*`` and ``?``
    stop at a slash.
    """
    steps = [_first_step(i, p) for i, p in enumerate(patterns)]
    found = spark.createDataFrame(steps, _STEP)
    for _ in range(max([len(s[3]) for s in steps], default=0) or 1):
        path = scratch_dir(spark)
        found.repartition("path").mapInPandas(_descend, _STEP).write.parquet(path)
        found = spark.read.schema(_STEP).parquet(path)
    return found.filter("size IS NOT NULL").select("arg", "path", "size")


def read_many(spark: SparkSession, patterns: list[str] | str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines ``(source_ord, source, line, text)`` as ``read_lines`` gives them, of any number of files.

    Files are in the order of arguments, then paths, by ranks over ranges (``source_ord`` counts binary files).  They are cut into ranges of bytes; tasks count
    the line ends of each (and find binary files, which have no lines), sums over the ranges of a file number the lines, and
    tasks read them, so bytes are read twice.  A gzip file is unpacked by the task of its first range.
    """
    files = list_files(spark, [patterns] if isinstance(patterns, str) else list(patterns))
    ranked = with_rank(files.withColumn("_parts", F.split("path", "/")), ["arg", "_parts"], "_rank")
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint")))
    ranges = ranked.select(
        (F.col("_rank") - 1).cast("int").alias("source_ord"), F.col("path").alias("source"), F.col("path").alias("uri"), "size",
        start.alias("start"))
    ranges = ranges.withColumn("stop", F.least(F.col("start") + range_bytes, "size"))
    ranges = ranges.withColumn("last", F.col("stop") == F.col("size")).repartition("source_ord", "start")
    counts = ranges.mapInPandas(
        count_lines, "source_ord int, source string, uri string, start bigint, stop bigint, last boolean, lines bigint")
    path = scratch_dir(spark)
    counts.write.parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path).filter("lines IS NOT NULL")
    earlier = Window.partitionBy("source_ord").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.withColumn("number", F.coalesce(F.sum("lines").over(earlier), F.lit(0)) + 1)
    return numbered.repartition("source_ord", "start").mapInPandas(read_numbered, LINES_SCHEMA)
