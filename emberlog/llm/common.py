"""What several corpus operators share: text keys, lineage cuts, connected components, shingles."""

from __future__ import annotations

from itertools import accumulate
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.session import scratch_dir

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a test folder, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder, so that a lost executor costs no more than a read."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or scratch_dir(spark))
    return df.checkpoint()


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other letter as it is."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def text_hash(text: Column) -> Column:
    """128 bits that stand for a text, null like empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; bytes know no other letters and no other space."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingles_of(words: list[bytes], n: int) -> list[bytes]:
    """All runs of n words, joined by a space; fewer words make one run, none make none."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n:
        return [joined]
    ends = list(accumulate(len(w) + 1 for w in words))
    return [joined[s : e - 1] for s, e in zip([0, *ends], ends[n - 1 :])]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``key``, cut anew so that no key is split, of ``least`` rows or more."""
    waiting, n, wanted = [], 0, least
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        n += batch.num_rows
        if n < wanted:
            continue
        joined = pa.concat_batches(waiting)
        differs = np.flatnonzero(group_starts(joined.column(key))[1:])
        cut = int(differs[-1]) + 1 if len(differs) else 0
        waiting, n = [joined.slice(cut)], joined.num_rows - cut
        wanted = max(least, 2 * n)
        if cut:
            yield joined.slice(0, cut)
    if waiting:
        yield pa.concat_batches(waiting)


def group_starts(keys: pa.Array) -> np.ndarray:
    """Which rows have another key than the row before."""
    codes = keys.dictionary_encode().indices.to_numpy()
    return np.append(True, codes[1:] != codes[:-1])


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected edges ``(a, b)``: the smallest node it can reach.

    Alternates large-star and small-star steps: every step hangs nodes on smaller ones until each hangs
    directly on the smallest of its component.  Only counts come to the driver; a hub is aggregated before it
    is joined, and its edges are a join's skewed side, which the adaptive join splits.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    pairs = checkpoint(pairs)
    seen = _state(pairs)
    while seen[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lowest = large.groupBy("a").agg(F.min("b").alias("b"))
        small = large.join(lowest.withColumnRenamed("b", "m"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = checkpoint(small.unionByName(lowest).distinct())
        now = _state(pairs)
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
