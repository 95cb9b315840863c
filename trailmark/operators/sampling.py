"""Negative sampling with draws that are a pure function of seed and keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions.columns import draw, permuted
from trailmark.operators.free_places import free_places
from trailmark.operators.ordering import Lanes, split_at
from trailmark.operators.splits import split_user_tail
from trailmark.storage import materialise

USER, ITEM = "user_index", "item_index"
LIST_ITEMS = 1_000  # items of a user that go along as a list


def seen_items(frame: DataFrame) -> DataFrame:
    return frame.select(USER, ITEM).distinct()


def negatives_per_user(seen: DataFrame, num_items: int, n: int = 4, seed: int = 42) -> DataFrame:
    """``n`` unseen items per user, uniform with replacement; none for users who have seen everything.

    A draw picks the r-th unseen item directly: with the seen items s_0 < s_1 <
    ..., it is r plus the number of i with s_i - i <= r. Nothing is rejected,
    and the count is a plain aggregate, so a user with a huge history is spread
    over tasks. ``seen`` holds distinct (user_index, item_index).
    """
    ranked = Lanes(seen, [USER], [ITEM]).row_number("_nth").result()
    gaps = ranked.select(USER, (F.col(ITEM) - F.col("_nth") + 1).alias("_unseen_before"))
    unseen = F.lit(num_items) - F.count("*")
    free = seen.groupBy(USER).agg(unseen.alias("_free")).filter(F.col("_free") > 0)
    numbers = range(1, n + 1)
    draws = free.select(
        USER, *(F.pmod(draw(seed, F.col(USER).cast("string"), F.lit(str(d))), F.col("_free")).alias(f"_r{d}") for d in numbers)
    )
    # one pass over the history counts all n draws of a user side by side
    counted = gaps.join(draws, USER).groupBy(USER).agg(
        *(F.first(f"_r{d}").alias(f"_r{d}") for d in numbers),
        *(F.count_if(F.col("_unseen_before") <= F.col(f"_r{d}")).alias(f"_skip{d}") for d in numbers),
    )
    rows = [F.struct(F.lit(d).alias("draw"), (F.col(f"_r{d}") + F.col(f"_skip{d}")).alias(ITEM)) for d in numbers]
    return counted.select(USER, F.inline(F.array(*rows)))


def labelled_pairs(frame: DataFrame, num_items: int, n: int = 4, seed: int = 42) -> DataFrame:
    """Distinct positives with label 1 and ``n`` negatives per user with label 0."""
    seen = materialise(seen_items(frame), "seen")
    if seen.isEmpty():
        raise ValueError("no interactions to label")
    negatives = negatives_per_user(seen, num_items, n, seed).select(USER, ITEM, F.lit(0.0).cast("float").alias("label"))
    return seen.withColumn("label", F.lit(1.0).cast("float")).unionByName(negatives)


def negatives_per_positive(positives: DataFrame, num_items: int, n: int = 4, seed: int = 42) -> DataFrame:
    """For every positive row ``n`` distinct unseen items of its user, no item twice per user.

    The target of a user is capped at the items left unseen. Draw j of a user is
    the unseen item whose rank is where a permutation of the user's unseen ranks
    sends j, at any share of the catalogue: nothing is rejected or drawn twice,
    and an added item leaves the number of draws of all users as it is.
    """
    seen = materialise(seen_items(positives), "seen")
    sizes = positives.groupBy(USER).agg(F.count("*").alias("_rows"))
    held = seen.groupBy(USER).agg((F.lit(num_items) - F.count("*")).alias("_free"))
    wanted = sizes.join(held, USER).select(USER, "_free", F.least(F.col("_rows") * n, F.col("_free")).alias("_want")).filter(F.col("_want") > 0)
    draws = wanted.select(USER, "_free", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_want") - 1)).alias("_draw"))
    ranks = draws.select(USER, permuted(seed, USER, F.col("_draw"), F.col("_free")).alias("_rank"))
    return free_places(ranks, seen, USER, "_rank", ITEM).select(USER, ITEM)


def negatives_bounded(positives: DataFrame, num_items: int, n: int = 4, seed: int = 42, tries: int = 10) -> DataFrame:
    """Up to ``n`` unseen items per positive row with replacement, from at most ``tries`` draws each.

    ``positives`` holds (user_index, item_index); the result keeps the positive
    item, which makes it the (user, positive, negative) triplets of pairwise training.
    Rows of users with up to LIST_ITEMS items carry those as a list, against which
    the draws are held where they are made; only draws of larger users are shuffled.
    """
    seen = materialise(seen_items(positives), "seen")
    many = seen.groupBy(USER).agg(F.count("*").alias("_held")).filter(F.col("_held") > LIST_ITEMS).select(USER)
    pick = lambda t: F.pmod(draw(seed, F.col(USER).cast("string"), F.col("positive_index").cast("string"), t.cast("string")), F.lit(num_items))

    few = seen.join(many, USER, "left_anti")
    held = few.groupBy(USER).agg(F.collect_list(ITEM).alias("_seen"))
    pairs = few.withColumnRenamed(ITEM, "positive_index").join(held, USER)
    unseen = F.filter(F.transform(F.sequence(F.lit(1), F.lit(n * tries)), pick), lambda i: ~F.array_contains("_seen", i))
    nearby = pairs.select(USER, "positive_index", F.posexplode(F.slice(unseen, 1, n)).alias("_nth", "negative_index"))

    pairs = seen.join(many, USER, "left_semi").withColumnRenamed(ITEM, "positive_index")
    draws = pairs.select("*", F.explode(F.sequence(F.lit(1), F.lit(n * tries))).alias("_try"))
    unseen = draws.withColumn(ITEM, pick(F.col("_try"))).join(seen, [USER, ITEM], "left_anti")
    window = Window.partitionBy(USER, "positive_index").orderBy("_try")
    spread = unseen.withColumn("draw", F.row_number().over(window)).filter(F.col("draw") <= n)

    columns = (USER, "positive_index", "negative_index", "draw")
    return nearby.withColumn("draw", F.col("_nth") + 1).select(*columns).unionByName(spread.withColumnRenamed(ITEM, "negative_index").select(*columns))


def random_negatives(pairs: DataFrame, num_users: int, num_items: int, n: int, seed: int = 42, tries: int = 10) -> DataFrame:
    """``n`` random (user, item) pairs that are no positives, from at most ``tries * n`` draws."""
    spark = pairs.sparkSession
    known = materialise(pairs.select(USER, ITEM).distinct(), "pairs")
    free = 1.0 - known.count() / (num_users * num_items)
    limit = tries * n
    budget = limit if free <= 0 else min(limit, math.ceil(n / free * 1.1) + 100)
    while True:
        ticket = F.col("id").cast("string")
        draws = spark.range(1, budget + 1).select(
            F.col("id").alias("draw"),
            F.pmod(draw(seed, F.lit("user"), ticket), F.lit(num_users)).alias(USER),
            F.pmod(draw(seed, F.lit("item"), ticket), F.lit(num_items)).alias(ITEM),
        )
        kept = materialise(draws.join(known, [USER, ITEM], "left_anti"), "random")
        count = kept.count()
        if count >= n or budget >= limit:
            break
        budget = min(limit, budget * 2)
    if count > n:
        kept = split_at(kept, ["draw"], [n], "_late", count).filter("_late = 0").drop("_late")
    return kept.select("draw", USER, ITEM)


def label_tables(
    encoded: DataFrame, num_items: int, n: int = 4, validation_ratio: float = 0.2, seed: int = 42, order: tuple = ("timestamp", ITEM)
) -> tuple[DataFrame, DataFrame]:
    """Train and validation pairs with labels: per-user tail split, then negatives per positive on both parts."""
    split = split_user_tail(encoded, list(order), validation_ratio, USER)
    result = []
    for name in ("train", "validation"):
        positives = split.filter(F.col("split") == name).select(USER, ITEM)
        negatives = negatives_per_positive(positives, num_items, n, seed)
        result.append(positives.withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0))))
    return result[0], result[1]
