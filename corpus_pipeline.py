"""A corpus pipeline: quality, exact copies, near copies, benchmark leaks, mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import decontaminate, exact_dedup, mixing, ngram_join, quality
from trailmark.session import configure
from trailmark.storage import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the compression classifier on the labelled documents and keep what it predicts to be good."""
    configure(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the one with the largest id."""
    configure(spark)
    return exact_dedup.drop_duplicates(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles keep the one with the smallest id."""
    configure(spark)
    return ngram_join.keep_one(docs, n=5, percent=80)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that contain most of a benchmark item, in whatever order."""
    configure(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken, epochs; untaken ones go."""
    configure(spark)
    return mixing.mix(docs).filter(F.col("taken") > 0)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("exact_dedup", no_copies),
    ("ngram_jaccard_join", no_near_copies),
    ("decontamination", no_leaks),
    ("mixing", mixed),
]

#: compression, shingle sets and tiling are beyond SQL; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
