"""Documents made ready for training, stage by stage; every stage is written and read again."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import load
from emberlog.llm.decontaminate import clean_documents
from emberlog.llm.language import fit, identify
from emberlog.llm.line_dedup import without_repeated_lines
from emberlog.llm.mixing import mixed_documents
from emberlog.llm.simhash import one_of_each_group
from emberlog.session import scratch_dir, tune_session


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(run: Stage) -> Stage:
    """The stage, after the library's settings are made and its code is sent to the executors."""
    @wraps(run)
    def ready(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return run(tune_session(spark), docs, sf_dir)

    return ready


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned; texts without letters or far from every language go."""
    return identify(docs, fit(docs)).filter(~F.col("rejected")).select("_row.*")


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document has."""
    return without_repeated_lines(docs)


@_stage
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, five-word shingles at a similarity of 0.8 or more."""
    return one_of_each_group(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return clean_documents(docs, load(spark, sf_dir, "benchmark"))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of sources takes, with the number of ``copies``."""
    return mixed_documents(docs, F.sqrt("size"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# No SQL: fingerprints, samples and trained classes are outside it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = f"{scratch_dir(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
