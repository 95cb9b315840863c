"""Dense id encoding and its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.ordering import dense_index


def id_table(frame: DataFrame, column: str, index: str = "idx") -> DataFrame:
    """Distinct ids as strings, numbered from 0 in string order."""
    ids = frame.select(F.col(column).cast("string").alias("id")).filter(F.col("id").isNotNull()).distinct()
    return dense_index(ids, ["id"], index)


def encode_ids(
    frame: DataFrame, user: str = "visitorid", item: str = "itemid"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The frame with ``user_index`` and ``item_index``, and both id tables.

    The id tables are stored, so their known size decides between a broadcast
    and a shuffled join; hot ids in a shuffled join are split at run time.
    """
    users, items = id_table(frame, user), id_table(frame, item)
    encoded = attach_index(attach_index(frame, users, user, "user_index"), items, item, "item_index")
    return encoded, users, items


def attach_index(frame: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
    renamed = table.select(F.col("id").alias("_id"), F.col("idx").alias(name))
    return frame.join(renamed, F.col(column).cast("string") == F.col("_id")).drop("_id")


def decode(frame: DataFrame, table: DataFrame, index: str, name: str) -> DataFrame:
    """Replace an index column by its id."""
    renamed = table.select(F.col("idx").alias(index), F.col("id").alias(name))
    return frame.join(renamed, index).drop(index)


def entity_counts(users: DataFrame, items: DataFrame) -> DataFrame:
    """Sizes of both id tables."""
    return users.agg(F.count("*").alias("users")).withColumn("items", items.agg(F.count("*")).scalar())


def one_hot_pairs(pairs: DataFrame, user: str = "user_index", item: str = "item_index") -> DataFrame:
    """User and item indicator as a sparse vector: a 1 at the user and a 1 at users + item."""
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    encoder = OneHotEncoder(inputCols=[user, item], outputCols=["_user_vec", "_item_vec"], dropLast=False)
    encoded = encoder.fit(pairs).transform(pairs)
    return VectorAssembler(inputCols=["_user_vec", "_item_vec"], outputCol="features").transform(encoded).drop("_user_vec", "_item_vec")
