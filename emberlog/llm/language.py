"""Language of a text by the nearest centroid.

A text is a vector of hashed letter bigrams and trigrams, damped counts times inverse document frequency, of length
one.  A language has a few centroids, clustered by cosine from a bounded sample of its documents.  The language of
the centroid nearest by cosine is predicted; a text is rejected if even that is too far for a text of its length.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import checkpoint

UNKNOWN = "und"
BUCKETS = 4096
# Documents learned from per language at most, centroids per language, rounds of clustering.
PER_LANGUAGE = 400
CENTROIDS = 3
_ROUNDS = 12
_SEED = 7
# Texts count by the power of two below their number of n-grams.  A text is rejected below this share of the
# cosine that all but a thousandth of the learned texts of that length reach.
_CLASSES = 24
_QUANTILE, _SLACK = 0.001, 0.6

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str | None) -> np.ndarray:
    """Buckets of all bigrams and trigrams of letters; a run of anything else is one border."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[points]
    if not is_letter.any():
        return np.empty(0, np.int64)
    points = np.where(is_letter, points, 32).astype(np.uint64)
    points = points[np.concatenate([[True], is_letter[1:] | is_letter[:-1]])]
    points = np.concatenate([[32], points, [32]]).astype(np.uint64)
    two = points[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] + points[2:] * np.uint64(0x165667B19E3779F9) + np.uint64(1)
    h = np.concatenate([two, three])
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(52)).astype(np.int64)  # 12 bits: BUCKETS


def _weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts) * idf
    norm = np.linalg.norm(rows, axis=-1, keepdims=True)
    return (rows / np.where(norm > 0, norm, 1)).astype(np.float32)


def _length_class(n: int) -> int:
    return min(n.bit_length(), _CLASSES - 1)


@dataclass(frozen=True)
class LanguageModel:
    """Centroids, their languages, term weights and the least cosine by length class."""

    languages: tuple[str, ...]
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, cosine of the nearest centroid, and whether that is too far."""
        langs, scores, rejected = [], [], []
        for at in range(0, len(texts), 256):
            found = [grams(t) for t in texts[at : at + 256]]
            if not self.languages:
                langs += [UNKNOWN] * len(found)
                scores += [0.0] * len(found)
                rejected += [True] * len(found)
                continue
            counts = np.stack([np.bincount(g, minlength=BUCKETS) for g in found])
            cosines = _weighed(counts, self.idf) @ self.centroids.T
            best = cosines.argmax(axis=1)
            for g, b, row in zip(found, best, cosines):
                score = float(np.clip(row[b], 0, 1))
                langs.append(self.languages[b] if len(g) else UNKNOWN)
                scores.append(score if len(g) else 0.0)
                rejected.append(not len(g) or score < self.least[_length_class(len(g))])
        return langs, scores, rejected


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; one without an id is neither held out nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _cluster(rows: np.ndarray, k: int) -> np.ndarray:
    """Centroids of unit vectors by cosine; farthest rows start the clusters, so reruns agree."""
    mean = rows.mean(axis=0)
    start = [int((rows @ mean).argmax())]
    while len(start) < min(k, len(rows)):
        start.append(int((rows @ rows[start].T).max(axis=1).argmin()))
    centres = rows[start]
    for _ in range(_ROUNDS):
        mine = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([rows[mine == i].sum(axis=0) if (mine == i).any() else c for i, c in enumerate(centres)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> LanguageModel:
    """Learn from the labelled rows of ``docs (doc_id, text, lang)`` that are not held out.

    At most ``per_language`` documents of each language, those with the smallest hash of their id, and for
    each some cuttings of doubling length that show how cosines fall for short texts.  What reaches the driver is one
    count per language, one number per bucket and the centroids.
    """
    labelled = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    labelled = labelled.withColumn("place", F.xxhash64("doc_id", F.lit(_SEED)))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # Twice the share needed passes a plain filter, so only few rows are ranked.
    limit = {lang: -(2**63) + min(2**64 - 1, int(2**64 * 2 * per_language / n)) for lang, n in counts.items()}
    limits = docs.sparkSession.createDataFrame(sorted(limit.items()), "_lang string, _limit bigint")
    few = labelled.join(F.broadcast(limits), F.expr("lang = _lang AND place <= _limit")).filter("text IS NOT NULL")
    sample = few.selectExpr("lang", "text", "row_number() OVER (PARTITION BY lang ORDER BY place, text) AS n").filter(F.col("n") <= per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, whole, sizes, buckets, values = [], [], [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                cuts = [text] + [text[len(text) // 3 :][: 2**j] for j in range(3, 14) if 2**j < len(text)]
                for i, cut in enumerate(cuts):
                    found = grams(cut)
                    if len(found):
                        b, v = np.unique(found, return_counts=True)
                        langs.append(lang), whole.append(i == 0), sizes.append(len(found)), buckets.append(b), values.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(whole, pa.bool_()), pa.array(sizes, pa.int32()),
                 pa.array(buckets, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32()))],
                ["lang", "whole", "size", "buckets", "counts"])

    counted = checkpoint(sample.select("lang", "text").mapInArrow(
        count, "lang string, whole boolean, size int, buckets array<int>, counts array<int>"))
    seen = counted.filter("whole").select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()
    total = counted.filter("whole").count()
    idf = np.full(BUCKETS, np.log(1.0 + total))
    for b, n in seen:
        idf[b] = np.log((1.0 + total) / (1.0 + n)) + 1.0

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        def rows_of(some: pd.DataFrame) -> np.ndarray:
            out = np.zeros((len(some), BUCKETS), np.float32)
            for i, (b, c) in enumerate(zip(some["buckets"], some["counts"])):
                out[i, b] = c
            return _weighed(out, idf)

        centres = _cluster(rows_of(part[part["whole"]].sort_values(["size"], kind="stable")), centroids)
        lows, classes = [], part["size"].map(lambda n: _length_class(int(n)))
        for c in range(_CLASSES):
            mine = part[classes == c]
            lows.append(float(np.quantile((rows_of(mine) @ centres.T).max(axis=1), _QUANTILE)) if len(mine) else -1.0)
        return pd.DataFrame({"lang": part["lang"].iloc[0], "centre": [c.tolist() for c in centres], "lows": [lows] * len(centres)})

    # A group holds the sample of one language: per_language documents and their cuttings at most.
    found = counted.groupBy("lang").applyInPandas(cluster, "lang string, centre array<float>, lows array<double>").collect()
    found.sort(key=lambda r: (r.lang, r.centre))
    lows = np.array([r.lows for r in found]) if found else np.full((1, _CLASSES), -1.0)
    least = np.where(lows >= 0, lows, np.inf).min(axis=0)
    least = np.where(np.isfinite(least), least * _SLACK, 0.0)
    centres = np.array([r.centre for r in found], np.float32).reshape(-1, BUCKETS)
    return LanguageModel(tuple(r.lang for r in found), centres, idf, least)


def identify(texts: DataFrame, model: LanguageModel) -> DataFrame:
    """Every row of ``texts`` packed in ``_row``, with ``lang_pred``, ``score`` (0 to 1) and ``rejected`` by its ``text``.

    A null text, and one without a letter, is ``und`` with score 0 and rejected; so is every text if nothing
    could be learned.  Rows are independent of each other, and nothing is shuffled.
    """
    broadcast = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_row")
            langs, scores, rejected = broadcast.value.predict(rows.field("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["_row", "lang_pred", "score", "rejected"])

    packed = texts.select(F.struct("*").alias("_row"))
    schema = T.StructType([
        packed.schema["_row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType())])
    return packed.mapInArrow(run, schema)
