"""Bounded, deterministic samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.llm.common import hash_key

KEY_RANGE = 2.0**60


def labelled_sample(rows: DataFrame, label: str, per_label: int, seed: str) -> DataFrame:
    """At most ``per_label`` rows (doc_id, label) of each label: those of smallest hash of the id.

    Rows are thinned to about twice that number per label before any are
    brought together, so that no task sorts all rows of a frequent label.
    """
    keyed = rows.select("doc_id", label).distinct().withColumn("_key", hash_key(seed, F.col("doc_id")))
    counts = keyed.groupBy(label).agg(F.count("*").alias("_rows"))
    bound = F.lit(KEY_RANGE) * (2 * per_label + 100) / F.col("_rows")
    thin = keyed.join(counts, label).filter(F.col("_key") < bound)
    place = F.row_number().over(Window.partitionBy(label).orderBy("_key", "doc_id"))
    return thin.withColumn("_place", place).filter(F.col("_place") <= per_label).select("doc_id", label, "_key")


def sample_texts(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str, most_chars: int, label: str) -> list[tuple[object, str]]:
    """Label and text of the picked rows in hash order, without null texts and those over ``most_chars``.

    Each label has a bounded number of picked rows, so the join may send them
    to all tasks and the texts may come to the driver.
    """
    text = F.col(text_col)
    short = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).filter(text.isNotNull() & (F.length(text) <= most_chars))
    found = short.join(F.broadcast(picked), "doc_id").select("_key", label, "_text").distinct()
    return [(r[label], r["_text"]) for r in sorted(found.collect(), key=lambda r: (r["_key"], str(r[label]), r["_text"]))]
