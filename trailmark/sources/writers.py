"""Sinks for frames, id tables, statistics and comparison results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(frame: DataFrame, path: str, by: str | None = None) -> None:
    """Overwrite a parquet table, optionally one folder per value of ``by``."""
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def write_id_tables(users: DataFrame, items: DataFrame, folder: str) -> None:
    """Both id tables, each as parquet."""
    write_parquet(users, f"{folder}/users")
    write_parquet(items, f"{folder}/items")


def entity_counts(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Number of users and items from stored id tables."""
    return tuple(spark.read.parquet(f"{folder}/{name}").count() for name in ("users", "items"))


def write_comparison(table: DataFrame, path: str) -> None:
    """The comparison table as one CSV file, best harmonic mean first; one row per model."""
    table.orderBy(F.desc("harmonic_mean_at_10"), "model").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
