"""Item-to-item neighbour recommenders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions.columns import whole_units
from trailmark.models.common import (
    COLUMNS,
    ITEM,
    USER,
    check_limit,
    cold_users,
    complete,
    item_counts,
    known_users,
    pairs_of,
    place_items,
    ranked_top,
    same_list,
    top_k,
    unseen_from,
)
from trailmark.operators.cleaning import top_keys
from trailmark.operators.cooccurrence import TASK_MEETINGS, cosine_neighbours, in_strip, numbered_neighbours, strip_count
from trailmark.operators.encoding import id_table
from trailmark.storage import discard, materialise

SCORE_UNITS = 1e9  # scores are sums of billionths


def _by_id(train: DataFrame) -> DataFrame:
    """The catalogue in id order, used to fill lists once the scored items are used up."""
    return id_table(train, ITEM).select(F.col("id").alias(ITEM), F.lit(0.0).alias("score"), (F.col("idx") + 1).alias("place"))


def item_knn(train: DataFrame, users: DataFrame, k: int = 10, n_neighbours: int = 20) -> DataFrame:
    """Vote model: an item scores one for every consumed item that lists it among its neighbours.

    An item counts as its own first neighbour, so ``n_neighbours - 1`` others
    vote. Unknown users get the popular items.
    """
    check_limit(k)
    history = materialise(pairs_of(train), "history")
    items, listed = numbered_neighbours(history, USER, ITEM, None, n_neighbours - 1, listed=True)
    warm = known_users(users, train)
    own = materialise(history.join(warm, USER, "left_semi").join(items, ITEM), "own")
    discard(history)
    # a user's items and the lists of their neighbours meet in one task; votes are counted and ranked there
    rows = own.count()
    strips = strip_count(rows * n_neighbours, rows)
    if strips > 1:
        listed = materialise(listed, "listed")
    ballot = F.coalesce(F.concat(F.array("_idx"), "_near"), F.array("_idx"))
    window = Window.partitionBy(USER).orderBy(F.desc("score"), "_idx")

    def elected(voters: DataFrame) -> DataFrame:
        dealt = voters.select(USER, "_idx").join(listed, F.col("_idx") == F.col("_i"), "left").repartition(rows * n_neighbours // strips // TASK_MEETINGS + 1, USER)
        votes = dealt.select(USER, F.posexplode(ballot).alias("_vote", "_idx")).groupBy(USER, "_idx").agg(
            F.count_if(F.col("_vote") > 0).cast("double").alias("score"), F.min("_vote").alias("_first")
        )
        ranked = votes.filter(F.col("_first") > 0).withColumn("rank", F.row_number().over(window))
        return ranked.filter(F.col("rank") <= k).select(USER, "_idx", "score", "rank")

    parts = [elected(own)] if strips == 1 else [materialise(elected(own.filter(in_strip(USER, s, strips))), "elected") for s in range(strips)]
    scored = reduce(DataFrame.unionByName, parts).join(items, "_idx").select(*COLUMNS)
    filled = complete(scored, _by_id(train), warm, own, k)
    cold = same_list(cold_users(users, train), ranked_top(item_counts(train), k))
    return filled.unionByName(cold)


def item_knn_weighted(
    weights: DataFrame, users: DataFrame, k: int = 10, n_neighbours: int = 50, max_items: int = 0
) -> DataFrame:
    """Weighted model: score = sum of weight times similarity; ``max_items`` keeps the heaviest items, 0 all.

    ``weights`` holds (user_id, item_id, weight). Users without any positive
    score, known or not, get the heaviest items they have not seen.
    """
    check_limit(k)
    totals = weights.groupBy(ITEM).agg(F.sum("weight").alias("score"))
    subset = weights
    if max_items > 0:
        subset = weights.join(top_keys(totals, ITEM, "score", max_items).select(ITEM), ITEM, "left_semi")
    neighbours = cosine_neighbours(subset, USER, ITEM, "weight", n_neighbours - 1)
    own = weights.join(users.select(USER), USER, "left_semi")
    scores = (
        own.join(neighbours.select(F.col("item").alias(ITEM), "neighbour", "similarity"), ITEM)
        .groupBy(USER, F.col("neighbour").alias(ITEM))
        .agg((F.sum(whole_units(F.col("weight") * F.col("similarity"), SCORE_UNITS)) / F.lit(SCORE_UNITS)).alias("score"))
    )
    scored = materialise(top_k(scores.filter(F.col("score") > 0).join(own, [USER, ITEM], "left_anti"), k), "lists")
    found = scored.select(USER).distinct()
    filled = complete(scored, _by_id(weights), found, own, k)
    rest = users.select(USER).join(found, USER, "left_anti")
    return filled.unionByName(unseen_from(place_items(totals), rest, weights, k))
