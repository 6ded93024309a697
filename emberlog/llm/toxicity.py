"""Toxicity of a text, learned from confirmed toxic examples and unlabelled text.

A text is the set of its words' beginnings, hashed.  Linear classifiers are trained in numpy on the non-negative
positive-unlabelled risk: with the share ``prior`` of toxic texts among all, the risk on clean texts is what the unlabelled
texts show less what the toxic ones among them must contribute, ``R_u(-) - prior * R_p(-)``.  Where that estimate falls below
zero the model has begun to learn its sample by heart, and the step goes the other way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 18
# Texts learned from at most: confirmed toxic ones, seen by every classifier, and unlabelled ones for each classifier.
TOXIC_SAMPLE, UNLABELLED_SAMPLE = 2000, 4000
CLASSIFIERS = 4
THRESHOLD = 0.3
# Lengths of the beginnings that stand for a word; a word of that many letters or fewer stands for itself.
_STEMS = (4, 5)
# A bucket is learned if so many toxic texts of the sample have it.
_LEAST_TEXTS = 3
_ROUNDS, _RATE, _DECAY = 150, 0.05, 5e-4
_SEED = 11

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> np.ndarray:
    """Buckets of the beginnings of all words, each once, ascending."""
    words = set(_WORD.findall(text.lower())) if text else ()
    stems = {w[:n] if len(w) >= n else f"{w}$" for w in words for n in _STEMS}
    if not stems:
        return np.empty(0, np.int32)
    joined = "\0".join(stems)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], points[:-1] == 0]))
    place = np.arange(len(points)) - np.repeat(starts, np.diff(np.append(starts, len(points))))
    mixed = (points + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    sums = np.add.reduceat(np.where(points == 0, np.uint64(0), mixed), starts)
    sums = (sums ^ (sums >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return np.unique((sums >> np.uint64(46)).astype(np.int32))  # 18 bits: BUCKETS


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from learning; a document without an id has no label to learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class _Rows:
    """Bucket sets of texts, one after another."""

    def __init__(self, rows: list[np.ndarray], wanted: np.ndarray):
        rows = [r[wanted[r]] for r in rows]
        self.flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
        self.owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n = len(rows)

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.owner, weights[self.flat], self.n) + bias

    def slope(self, by_row: np.ndarray, size: int) -> np.ndarray:
        """Gradient of the mean over the rows: one number per bucket and, last, the bias."""
        mean = by_row / max(self.n, 1)
        return np.append(np.bincount(self.flat, mean[self.owner], size), mean.sum())


def train(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, size: int = BUCKETS) -> np.ndarray:
    """Weights per bucket and, last, the bias, by the non-negative risk with the logistic loss.

    Weights are zero or more, so that a long clean text does not make up for a toxic word in it; their sum is charged, so
    that words toxic texts share with all others get none.
    """
    learned = np.bincount(np.concatenate([np.empty(0, np.int32), *toxic]), minlength=size) >= _LEAST_TEXTS
    p, u = _Rows(toxic, learned), _Rows(unlabelled, learned)
    theta = np.zeros(size + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, _ROUNDS + 1):
        at_p, at_u = p.scores(theta[:-1], theta[-1]), u.scores(theta[:-1], theta[-1])
        clean_risk = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
        clean_slope = u.slope(_sigmoid(at_u), size) - prior * p.slope(_sigmoid(at_p), size)
        if clean_risk < 0:
            slope = -clean_slope
        else:
            slope = clean_slope - prior * p.slope(_sigmoid(-at_p), size)
        slope[:-1] += _DECAY
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        theta -= _RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0)
    return theta


@dataclass(frozen=True)
class ToxicityModel:
    """Mean weights of the classifiers, and their mean bias; a bias of minus infinity knows no toxic text."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """Between 0 and 1, from the whole text; a text without words has the bias alone."""
        return float(_sigmoid(self.weights[features(text)].sum() + self.bias)) if np.isfinite(self.bias) else 0.0


def fit(
    docs: DataFrame, labels: DataFrame, toxic_sample: int = TOXIC_SAMPLE, unlabelled_sample: int = UNLABELLED_SAMPLE,
    classifiers: int = CLASSIFIERS,
) -> ToxicityModel:
    """Learn from ``docs (doc_id, text)`` and the ids that ``labels (doc_id, toxic)`` marks with 1.

    Nothing is learned from held-out documents.  An id is toxic if any of its labels is 1; the prior is the share of
    toxic ids among the labelled ones.  Samples are the ids with the smallest hashes: ``toxic_sample`` toxic ones, and
    for each classifier ``unlabelled_sample`` of all ids, whatever their label.  Where an id has several texts, one of them is
    taken.  Rows without an id are not learned from.  Without a toxic document every score will be 0.
    What reaches the driver is two counts and, per classifier, at most one number per bucket.
    """
    doc_id = F.col("doc_id").cast("bigint")
    known = docs.select(doc_id.alias("doc_id")).filter("doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).distinct()
    marked = labels.select(doc_id.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IS NOT NULL")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = known.join(marked, "doc_id")
    n, n_toxic = marked.agg(F.count("*"), F.count(F.when(F.col("toxic") == 1, 1))).first()
    if not n_toxic:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), -np.inf)
    prior = min(max(n_toxic / n, 0.001), 0.999)

    place = F.xxhash64("doc_id", F.lit(_SEED))
    toxic = marked.filter("toxic = 1").orderBy(place, "doc_id").limit(toxic_sample)
    others = known.orderBy(place, "doc_id").limit(unlabelled_sample * classifiers)
    # Bounded by the samples' sizes, so both are sent to every task and no text is shuffled.
    chosen = toxic.select("doc_id", F.lit(-1).alias("part")).unionByName(
        others.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(_SEED + 1)), F.lit(classifiers)).cast("int").alias("part")))
    texts = docs.select(doc_id.alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "part", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "part", "buckets"])

    counted = texts.mapInArrow(count, "doc_id bigint, part int, buckets array<int>")
    counted = counted.groupBy("doc_id", "part").agg(F.min("buckets").alias("buckets"))
    every = F.explode(F.when(F.col("part") < 0, F.sequence(F.lit(0), F.lit(classifiers - 1))).otherwise(F.array("part")))
    dealt = counted.select("buckets", (F.col("part") < 0).alias("toxic"), "doc_id", every.alias("classifier"))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["toxic", "doc_id"])
        theta = train(list(part["buckets"][part["toxic"]]), list(part["buckets"][~part["toxic"]]), prior)
        used = np.flatnonzero(theta)
        return pd.DataFrame({"buckets": [used.tolist()], "weights": [theta[used].tolist()]})

    # A group holds the samples of one classifier: toxic_sample and unlabelled_sample documents at most, in expectation.
    found = dealt.groupBy("classifier").applyInPandas(learn, "buckets array<int>, weights array<double>").collect()
    theta = np.zeros(BUCKETS + 1)
    for row in found:
        theta[row.buckets] += np.array(row.weights) / len(found)
    return ToxicityModel(theta[:-1].astype(np.float32), float(theta[-1]))


def with_scores(texts: DataFrame, model: ToxicityModel) -> DataFrame:
    """Every row of ``texts`` packed in ``_row``, with ``score`` and ``predicted`` (0 or 1) by its ``text``; nothing is shuffled."""
    broadcast = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_row")
            scores = np.array([broadcast.value.score(t) for t in rows.field("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["_row", "score", "predicted"])

    packed = texts.select(F.struct("*").alias("_row"))
    schema = T.StructType([
        packed.schema["_row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return packed.mapInArrow(run, schema)
