"""Popularity, recency and random recommenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions.columns import draw
from trailmark.models.common import (
    ITEM,
    USER,
    check_limit,
    item_counts,
    pairs_of,
    place_items,
    ranked_top,
    same_list,
    unseen_from,
    unseen_upto,
)
from trailmark.operators.encoding import id_table
from trailmark.storage import materialise


def popularity(train: DataFrame, users: DataFrame, k: int = 10, exclude_seen: bool = False) -> DataFrame:
    """Most frequent items, the same list for everybody unless seen items are excluded."""
    check_limit(k)
    if exclude_seen:
        return unseen_from(place_items(item_counts(train)), users, pairs_of(train), k)
    return same_list(users, ranked_top(item_counts(train), k))


def popularity_upto(train: DataFrame, wanted: DataFrame) -> DataFrame:
    """The most frequent unseen items of each user, as many as the ``limit`` of ``wanted`` (user_id, limit)."""
    return unseen_upto(place_items(item_counts(train)), wanted, pairs_of(train))


def most_popular(weights: DataFrame, users: DataFrame, k: int = 10, exclude_seen: bool = True) -> DataFrame:
    """Items by summed clipped weight (user_id, item_id, weight).

    Seen items are left out; a user with fewer than ``k`` items left gets the
    overall top appended.
    """
    check_limit(k)
    totals = weights.groupBy(ITEM).agg(F.sum("weight").alias("score"))
    if not exclude_seen:
        return same_list(users, ranked_top(totals, k))
    places = place_items(totals)
    fresh = materialise(unseen_from(places, users, weights, k), "lists")
    have = fresh.groupBy(USER).agg(F.count("*").alias("_have"))
    short = users.select(USER).join(have, USER, "left").withColumn("_have", F.coalesce("_have", F.lit(0))).filter(F.col("_have") < k)
    padding = same_list(short, ranked_top(totals, k)).join(short, USER).filter(F.col("_have") + F.col("rank") <= k)
    padded = padding.select(USER, ITEM, "score", (F.col("_have") + F.col("rank")).cast("int").alias("rank"))
    return fresh.unionByName(padded)


def recent_items(train: DataFrame, users: DataFrame, k: int = 10, time: str = "timestamp", tie: str | None = None) -> DataFrame:
    """Items by their last occurrence, newest first; equal times by the numeric ``tie``, then by item."""
    check_limit(k)
    parts = [time] if tie is None else [time, tie]
    last = train.groupBy(ITEM).agg(F.max(F.struct(*parts)).alias("_last"))
    best = last.orderBy(F.desc("_last"), ITEM).limit(k)
    newest_first = F.struct(*((-F.col(f"_last.{p}")).alias(p) for p in parts), F.col(ITEM))
    listed = best.agg(F.array_sort(F.collect_list(newest_first)).alias("listed")).select(F.posexplode("listed"))
    ranked = listed.select(
        F.col(f"col.{ITEM}").alias(ITEM), (-F.col(f"col.{time}")).cast("double").alias("score"), (F.col("pos") + 1).alias("rank")
    )
    return same_list(users, ranked)


def random_items(train: DataFrame, users: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """``k`` different items per user, uniform without replacement, fixed by seed and user.

    The j-th draw picks the r-th of the items not drawn yet, at any size of the
    catalogue. With the drawn ones in order s_0 < s_1 < ..., that is item r plus the
    number of i with s_i - i <= r. A user gets fewer than ``k`` only where there are fewer items.
    """
    check_limit(k)
    items = id_table(train, ITEM)
    n = items.count()
    if n == 0:
        return users.limit(0).select(USER, F.lit(None).cast("string").alias(ITEM), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))

    def pick(drawn: Column, j: Column) -> Column:
        r = F.pmod(draw(seed, F.col(USER), j.cast("string")), F.lit(n) - j + 1)
        return F.array_append(drawn, r + F.size(F.filter(F.array_sort(drawn), lambda s, i: s - i <= r)))

    numbers = F.sequence(F.lit(1), F.lit(min(k, n)))
    drawn = users.select(USER, F.posexplode(F.aggregate(numbers, F.array().cast("array<bigint>"), pick)).alias("_at", "idx"))
    return drawn.join(items, "idx").select(USER, F.col("id").alias(ITEM), F.lit(0.0).alias("score"), (F.col("_at") + 1).alias("rank"))
