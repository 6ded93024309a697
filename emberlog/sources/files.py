"""Text log files: plain or gzip, by path or glob."""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.sources.lines import strip_return

PROBE_BYTES = 8192
_CHUNK_BYTES = 1 << 20
# Bytes of a row besides its path, generously.
_ROW_BYTES = 64
LINES_SCHEMA = "source_ord int, source string, line bigint, text string"

# Names Spark decompresses by.
_CODEC_NAME = r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd)$"


@dataclass(frozen=True)
class LogFile:
    """``uri`` opens the file, ``key`` is the spelling of it that a scan reports."""

    source: str
    uri: str
    key: str
    size: int


def _pattern(text: str) -> str:
    """The glob for Hadoop, which reads braces as alternatives where they are meant as they are."""
    return re.sub(r"(?<!\\)([{}])", r"\\\1", text)


def _name(text: str, path: str, uri: str) -> str:
    """A file's name in the style of the argument it came from."""
    if "://" in text:
        return uri
    return path if text.startswith("/") else os.path.relpath(path)


def resolve(spark: SparkSession, paths: list[str]) -> list[LogFile]:
    """Files in argument order, then glob order; a file named twice appears twice, a missing one never.

    A pattern that matches nothing, or is malformed, is taken as a plain path.
    """
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    found: list[LogFile] = []
    for text in paths:
        fs = hadoop_path(text).getFileSystem(conf)
        try:
            statuses = list(fs.globStatus(hadoop_path(_pattern(text))) or [])
        except Exception:  # a malformed pattern is an ordinary file name
            statuses = []
        if not statuses:
            try:
                statuses = [fs.getFileStatus(hadoop_path(text))]
            except Exception:
                continue
        plain = not re.search(r"[*?\[\\]", text)
        for status in sorted(statuses, key=lambda s: s.getPath().toUri().getPath().split("/")):
            if status.isFile():
                path, uri = status.getPath().toUri().getPath(), status.getPath().toString()
                key = re.sub("^file:/+", "file:/", status.getPath().toUri().toString())
                found.append(LogFile(text if plain else _name(text, path, uri), uri, key, status.getLen()))
    return found


def probe(spark: SparkSession, files: list[LogFile]) -> DataFrame:
    """``(uri, gzip, binary)`` of each file, from its first 8 KB.

    Gzip is told by its first two bytes; a NUL byte makes any other file binary.
    """
    uris = sorted({f.uri for f in files})
    table = spark.createDataFrame([(u,) for u in uris], "uri string")
    parts = max(1, min(len(uris), 4 * spark.sparkContext.defaultParallelism))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads = [_read_head(u) for u in batch["uri"]]
            yield pd.DataFrame({
                "uri": batch["uri"],
                "gzip": [h[:2] == b"\x1f\x8b" for h in heads],
                "binary": [h[:2] != b"\x1f\x8b" and b"\0" in h for h in heads],
            })

    return table.repartition(parts).mapInPandas(look, "uri string, gzip boolean, binary boolean")


def _open(uri: str):
    import pyarrow.fs as pafs

    if uri.startswith("file:"):
        fs, path = pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    else:
        fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_stream(path, compression=None)


def _read_head(uri: str) -> bytes:
    with _open(uri) as stream:
        return stream.read(PROBE_BYTES)


def _pieces(uri: str, gzip: bool) -> Iterator[bytes]:
    """A file's bytes in pieces of bounded size, decompressed if asked for; a gzip file may have several members."""
    decoder = zlib.decompressobj(31)
    with _open(uri) as stream:
        while chunk := stream.read(_CHUNK_BYTES):
            if not gzip:
                yield chunk
                continue
            while chunk:
                yield decoder.decompress(chunk, _CHUNK_BYTES)
                chunk = decoder.unconsumed_tail
                if decoder.eof:
                    chunk, decoder = decoder.unused_data, zlib.decompressobj(31)
    if gzip:
        yield decoder.flush()


def _chunks(uri: str, gzip: bool) -> Iterator[tuple[int, str]]:
    """Whole lines of a file, a megabyte and more at a time, with the number of the first."""
    number, held, size = 1, [], 0
    for piece in _pieces(uri, gzip):
        held.append(piece)
        size += len(piece)
        if size < _CHUNK_BYTES or b"\n" not in piece:
            continue
        whole, _, rest = b"".join(held).rpartition(b"\n")
        yield number, whole.decode("utf-8", "replace")
        number += whole.count(b"\n") + 1
        held, size = [rest], len(rest)
    if last := b"".join(held):
        yield number, last.removesuffix(b"\n").decode("utf-8", "replace")


def _scan_text(spark: SparkSession, files: list[LogFile]) -> DataFrame:
    """``(key, line, text)`` of plain files.

    A line's number is its place in its split plus the lines of the splits before.  The splits are counted
    by a scan that reads no columns, and only those counts are joined; the text is never shuffled.  Both
    scans must be cut into the same splits; a row that fits no counted split stops the query.  Set
    ``spark.sql.files.minPartitionNum`` where executors come and go, which alone could move the splits.
    """
    literal = sorted({re.sub(r"([*?\[\]{}\\])", r"\\\1", f.uri) for f in files})
    scan = spark.read.text(literal, lineSep="\n").select(
        F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("key"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("text"),
    )
    splits = scan.groupBy("key", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    w = Window.partitionBy("key").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    split_bytes = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    # The split size can be lowered for parallelism, to a share per core at least.
    count = sum(f.size // split_bytes + 1 for f in files) + spark.sparkContext.defaultParallelism
    splits = _sent_if_small(spark, splits, count * (_ROW_BYTES + max((len(f.key) for f in files), default=0)))
    place = F.col("_id") - F.col("_first")
    line = F.when((place >= 0) & (place < F.col("_n")), F.col("_before") + place + 1).otherwise(
        F.raise_error(F.lit("file splits moved between counting and reading lines"))
    )
    return scan.join(splits, ["key", "_start"], "left").select(
        "key", line.cast("bigint").alias("line"), strip_return(F.col("text")).alias("text")
    )


def _sent_if_small(spark: SparkSession, df: DataFrame, size: int) -> DataFrame:
    """A broadcast hint where the rows take no more than the session broadcasts by itself; else the join is left to Spark."""
    limit = _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    return F.broadcast(df) if size <= limit else df


def _bytes(text: str) -> int:
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    number = text.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return int(number) * units.get(text[len(number):].lower(), 1)


def _scan_chunked(spark: SparkSession, files: dict[LogFile, bool]) -> DataFrame:
    """``(key, line, text)`` of gzip files and of others that Spark would open the wrong way (file -> is gzip).

    A file is unpacked once, by one task, which numbers its lines and hands them on by the megabyte; from there on they
    are spread over all tasks.
    """
    rows = sorted({(f.key, f.uri, gzip) for f, gzip in files.items()})
    table = spark.createDataFrame(rows, "key string, uri string, gzip boolean").repartition(len(rows), "key")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, uri, gzip in zip(batch["key"], batch["uri"], batch["gzip"]):
                for first, body in _chunks(uri, gzip):
                    yield pd.DataFrame({"key": [key], "first": [first], "body": [body]})

    chunks = table.mapInPandas(read, "key string, first bigint, body string").repartition("key", "first")
    lines = chunks.select("key", "first", F.posexplode(F.split("body", "\n")).alias("place", "text"))
    return lines.select("key", (F.col("first") + F.col("place")).alias("line"), strip_return(F.col("text")).alias("text"))


def read_lines(
    spark: SparkSession, paths: list[str] | str, max_line_bytes: int | None = None, probe_files: bool = True
) -> DataFrame:
    """Lines ``(source_ord, source, line, text)`` of log files.

    Missing and binary files are skipped.  Lines of any length are kept whole; ``max_line_bytes`` adds a column
    ``too_long`` that tells which are longer.  ``probe_files=False`` skips the look at each file's
    first bytes where it is known that there are only plain files and files named ``.gz``.
    """
    files = resolve(spark, [paths] if isinstance(paths, str) else list(paths))
    packed = {f: True for f in files if f.uri.endswith(".gz")}
    if probe_files and files:
        kinds = probe(spark, files)
        compressed = F.regexp_extract("uri", _CODEC_NAME, 0) != ""
        # Only the exceptions come back: what to skip, and what Spark would open the wrong way.
        odd = kinds.filter(F.col("binary") | (F.col("gzip") != F.endswith("uri", F.lit(".gz"))) | (~F.col("gzip") & compressed))
        odd = {r.uri: r for r in odd.collect()}
        files = [f for f in files if f.uri not in odd or not odd[f.uri].binary]
        packed = {f: odd[f.uri].gzip if f.uri in odd else True for f in files if f.uri in odd or f in packed}
    plain = [f for f in files if f not in packed]
    parts = ([_scan_text(spark, plain)] if plain else []) + ([_scan_chunked(spark, packed)] if packed else [])
    if not parts:
        return spark.createDataFrame([], LINES_SCHEMA)
    lines = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    named = [(i, f.source, f.key) for i, f in enumerate(files)]
    names = spark.createDataFrame(named, "source_ord int, source string, key string")
    names = _sent_if_small(spark, names, sum(_ROW_BYTES + len(s) + len(k) for _, s, k in named))
    lines = lines.join(names, "key", "left").withColumn("source_ord", F.coalesce(
        "source_ord", F.raise_error(F.concat(F.lit("unexpected file: "), F.col("key"))).cast("int")))
    lines = lines.select("source_ord", "source", "line", "text")
    if max_line_bytes is not None:
        lines = lines.withColumn("too_long", F.octet_length("text") > max_line_bytes)
    return lines
