"""Column expressions and readers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def hash_key(seed: str, *parts: Column) -> Column:
    """A 60-bit pseudo-random number from md5 over seed and parts; null counts as the empty string."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def learnable(doc_id: Column, folds: int, held: int) -> Column:
    """Whether a row may be learned from: crc32 of the id as text, modulo ``folds``, is not ``held``. Null ids never are."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds != held, F.lit(False))


def held_out(doc_id: Column, folds: int, held: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == held, F.lit(False))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
