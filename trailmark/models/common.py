"""Shared steps of the recommenders. Recommendations are rows (user_id, item_id, score, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.operators.free_places import free_places
from trailmark.operators.ordering import Lanes, dense_index
from trailmark.storage import materialise

USER, ITEM = "user_id", "item_id"
COLUMNS = (USER, ITEM, "score", "rank")


def pairs_of(train: DataFrame) -> DataFrame:
    """Distinct interactions; the history and the seen items of every user."""
    return train.select(USER, ITEM).distinct()


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best scores per user, ties to the smaller item; cut to ``k`` per task before the shuffle."""
    window = Window.partitionBy(USER).orderBy(F.desc("score"), ITEM)
    return scores.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select(*COLUMNS)


def same_list(users: DataFrame, ranked: DataFrame) -> DataFrame:
    """Give every user the same short list (item_id, score, rank), held as one scalar value."""
    entry = F.struct("rank", ITEM, "score")
    listed = ranked.agg(F.array_sort(F.collect_list(entry))).scalar()
    return users.select(USER, F.inline(listed)).select(*COLUMNS)


def item_counts(train: DataFrame) -> DataFrame:
    return train.groupBy(ITEM).agg(F.count("*").cast("double").alias("score"))


def ranked_top(scores: DataFrame, k: int) -> DataFrame:
    """The overall ``k`` best items with their rank."""
    best = scores.orderBy(F.desc("score"), ITEM).limit(k)
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), ITEM))).alias("listed"))
    return listed.select(F.posexplode("listed")).select(
        F.col(f"col.{ITEM}").alias(ITEM), (-F.col("col.down")).alias("score"), (F.col("pos") + 1).alias("rank")
    )


def place_items(scores: DataFrame) -> DataFrame:
    """Items numbered from 1 by descending score: (item_id, score, place)."""
    return dense_index(scores.withColumn("_down", -F.col("score")), ["_down", ITEM], "place", start=1).drop("_down")


def unseen_from(places: DataFrame, users: DataFrame, taken: DataFrame, k: int) -> DataFrame:
    """The first ``k`` items of a global order that each user has not taken.

    With the taken places s_1 < s_2 < ... of a user, the j-th free place is j
    plus the number of i with s_i - i < j. So ``k`` counters per user replace
    any user-by-item product, whatever the length of the history.
    """
    held = taken.select(USER, ITEM).distinct().join(places.select(ITEM, "place"), ITEM).select(USER, "place")
    numbered = Lanes(held, [USER], ["place"]).row_number("_nth").result()
    gap = F.col("place") - F.col("_nth")
    counters = [F.count_if(gap < j).alias(f"_c{j}") for j in range(1, k + 1)]
    per_user = numbered.filter(gap < k).groupBy(USER).agg(*counters)
    rows = [
        F.struct(F.lit(j).alias("rank"), (F.lit(j) + F.coalesce(f"_c{j}", F.lit(0))).alias("place")) for j in range(1, k + 1)
    ]
    wanted = users.select(USER).join(per_user, USER, "left").select(USER, F.inline(F.array(*rows)))
    return wanted.join(places, "place").select(*COLUMNS)


def unseen_upto(places: DataFrame, wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """The first ``limit`` items of a global order that each user of ``wanted`` (user_id, limit) has not taken.

    The limit is a column, so one user may ask for the whole catalogue beside
    others that ask for ten, and the plan is the same.
    """
    asks = wanted.select(USER, F.explode(F.sequence(F.lit(0).cast("long"), F.col("limit").cast("long") - 1)).alias("_rank")).filter("_rank >= 0")
    held = taken.join(wanted.select(USER).distinct(), USER, "left_semi").join(places.select(ITEM, "place"), ITEM)
    found = free_places(asks, held.select(USER, (F.col("place") - 1).alias("_place")).distinct(), USER, "_rank", "_place")
    numbered = found.select(USER, (F.col("_rank") + 1).cast("int").alias("rank"), (F.col("_place") + 1).alias("place"))
    return numbered.join(places, "place").select(*COLUMNS)


def complete(recommendations: DataFrame, places: DataFrame, users: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Fill lists shorter than ``k`` with unseen items from a global order, scored 0."""
    recommendations = materialise(recommendations, "lists")
    have = recommendations.groupBy(USER).agg(F.count("*").alias("_have"))
    # stored, so that the seen rows of users with full lists are not shuffled where few lists are short
    short = materialise(users.select(USER).join(have, USER, "left").withColumn("_have", F.coalesce("_have", F.lit(0))).filter(F.col("_have") < k), "short")
    taken = seen.select(USER, ITEM).unionByName(recommendations.select(USER, ITEM)).join(short.select(USER), USER, "left_semi")
    extra = unseen_from(places, short, taken, k).join(short, USER).filter(F.col("_have") + F.col("rank") <= k)
    filled = extra.select(USER, ITEM, F.lit(0.0).alias("score"), (F.col("_have") + F.col("rank")).cast("int").alias("rank"))
    return recommendations.select(*COLUMNS).unionByName(filled)


def known_users(users: DataFrame, train: DataFrame) -> DataFrame:
    return users.select(USER).join(train.select(USER).distinct(), USER, "left_semi")


def cold_users(users: DataFrame, train: DataFrame) -> DataFrame:
    return users.select(USER).join(train.select(USER).distinct(), USER, "left_anti")


def as_lists(recommendations: DataFrame) -> DataFrame:
    """One row per user with the ordered item array; at most one list length of rows per user."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", ITEM)))
    return recommendations.groupBy(USER).agg(F.transform(ordered, lambda e: e[ITEM]).alias("recommendations"))


def check_limit(k: int) -> int:
    if k < 1:
        raise ValueError("the list length must be at least 1")
    return k
