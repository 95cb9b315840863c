"""Logical tables of the data model, derived from the provided parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.columns import FUNNEL, epoch_ms

PART_ROWS = 25_000  # rows of part that one task turns into values


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """Click-stream rows of every event type."""
    kind = (
        F.when(F.col("event_type") == "click", "addtocart")
        .when(F.col("event_type") == "purchase", "transaction")
        .otherwise(F.col("event_type"))
    )
    return table(spark, folder, "events").select(
        epoch_ms(F.col("ts")).alias("timestamp"),
        F.col("user_id").alias("visitorid"),
        kind.alias("event"),
        F.get_json_object("props", "$.k").cast("bigint").alias("itemid"),
        F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("transactionid"),
        "event_id",
    )


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    """The funnel events only."""
    types = {"view": "view", "addtocart": "click", "transaction": "purchase"}
    source = table(spark, folder, "events").filter(F.col("event_type").isin(*(types[f] for f in FUNNEL)))
    kind = (
        F.when(F.col("event_type") == "click", "addtocart")
        .when(F.col("event_type") == "purchase", "transaction")
        .otherwise("view")
    )
    return source.select(
        epoch_ms(F.col("ts")).alias("timestamp"),
        F.col("user_id").alias("visitorid"),
        kind.alias("event"),
        F.get_json_object("props", "$.k").cast("bigint").alias("itemid"),
        F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("transactionid"),
        "event_id",
    )


def property_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Item-property changelog: signup rows set a category, error rows the availability."""
    source = table(spark, folder, "events").filter(F.col("event_type").isin("signup", "error"))
    modulus = F.when(F.col("event_type") == "signup", 25).otherwise(2)
    return source.select(
        epoch_ms(F.col("ts")).alias("timestamp"),
        F.get_json_object("props", "$.k").cast("bigint").alias("itemid"),
        F.when(F.col("event_type") == "signup", "categoryid").otherwise("available").alias("property"),
        (F.floor("value") % modulus).cast("string").alias("value"),
        F.col("event_id").alias("change_id"),
    )


def category_tree(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("categoryid"),
        F.col("n_regionkey").cast("bigint").alias("parentid"),
    )


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as interactions: the customer is the user, the part the item."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    kind = (
        F.when(F.col("l_returnflag") == "A", "addtocart")
        .when(F.col("l_returnflag") == "R", "transaction")
        .otherwise("view")
    )
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        epoch_ms(F.col("o_orderdate")).alias("timestamp"),
        F.col("o_custkey").alias("visitorid"),
        kind.alias("event"),
        F.col("l_partkey").alias("itemid"),
    )


def part_values(spark: SparkSession, folder: str) -> DataFrame:
    """Property values in the encoded grammar, three rows per part and property.

    The small part rows are dealt out first, so that no task makes values of more
    than about PART_ROWS of them, however few files they come from.
    """
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    part = part.repartition(part.count() // PART_ROWS + 1, "p_partkey")
    number = F.format_string("n%.3f", "p_retailprice")
    key = F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("string")
    values = F.array(
        F.struct(F.col("p_brand").alias("property"), key.alias("value")),
        F.struct(F.col("p_brand").alias("property"), number.alias("value")),
        F.struct(F.col("p_type").alias("property"), F.concat_ws(" ", key, size).alias("value")),
        F.struct(F.col("p_type").alias("property"), F.concat_ws(" ", key, number).alias("value")),
        F.struct(F.lit("categoryid").alias("property"), size.alias("value")),
        F.struct(F.lit("available").alias("property"), (F.col("p_partkey") % 2).cast("string").alias("value")),
        F.struct(F.concat(F.lit("raw_"), "p_type").alias("property"), F.concat(F.lit("n"), size).alias("value")),
        F.struct(F.concat(F.lit("raw_"), "p_type").alias("property"), F.col("p_brand").alias("value")),
    )
    return part.select(F.col("p_partkey").alias("itemid"), F.explode(values).alias("v"), F.col("p_size").cast("bigint").alias("timestamp")).select(
        "timestamp", "itemid", "v.property", "v.value"
    )
