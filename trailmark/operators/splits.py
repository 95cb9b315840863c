"""Chronological splits, truth tables and warm/cold analysis.

A split is one table with a ``split`` column. Positions are turned into the
order keys found at the cuts, so labelling rows is a projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.columns import EVENT_WEIGHTS
from trailmark.operators.cleaning import dedupe_first, require_columns, resolve_columns
from trailmark.operators.ordering import Lanes, split_at
from trailmark.operators.profiling import interaction_weights

PARTS = ("train", "validation", "test")


def _label(frame: DataFrame, order: Sequence[str], cuts: Sequence[int], names: Sequence[str], total: int) -> DataFrame:
    marked = split_at(frame, order, cuts, "_part", total)
    name = F.element_at(F.array(*map(F.lit, names)), F.col("_part") + 1)
    return marked.withColumn("split", name).drop("_part")


def positional_bounds(n: int, train_ratio: float = 0.70, val_ratio: float = 0.15) -> tuple[int, int]:
    """Row positions where training and validation end; products are truncated as doubles."""
    if n < 3:
        raise ValueError("a three-way split needs at least 3 rows")
    train_end = max(1, int(n * train_ratio))
    val_end = min(max(train_end + 1, int(n * (train_ratio + val_ratio))), n - 1)
    if not 0 < train_end < val_end < n:
        raise ValueError(f"the ratios leave a part of the {n} rows empty")
    return train_end, val_end


def split_positional(frame: DataFrame, order: Sequence[str], train_ratio: float = 0.70, val_ratio: float = 0.15) -> DataFrame:
    """Three parts by position in time order."""
    total = frame.count()
    return _label(frame, order, positional_bounds(total, train_ratio, val_ratio), PARTS, total)


def split_holdout(frame: DataFrame, order: Sequence[str], test_ratio: float = 0.15) -> DataFrame:
    """Train and test, the latest share for test."""
    total = frame.count()
    n_test = max(1, int(total * test_ratio))
    return _label(frame, order, [total - n_test], ("train", "test"), total)


def split_three_way(frame: DataFrame, order: Sequence[str], val_ratio: float = 0.15, test_ratio: float = 0.15) -> DataFrame:
    """Train, validation and test, the latest shares held out."""
    total = frame.count()
    n_val, n_test = max(1, int(total * val_ratio)), max(1, int(total * test_ratio))
    n_train = max(1, total - n_val - n_test)
    return _label(frame, order, [n_train, n_train + n_val], PARTS, total)


def split_time_range(frame: DataFrame, train_share: float = 0.70, val_share: float = 0.15, time: str = "timestamp") -> DataFrame:
    """Three parts at fixed shares of the covered time range; no ranking involved."""
    bounds = frame.agg(F.min(time).alias("low"), F.max(time).alias("high")).first()
    if bounds["low"] is None:
        return frame.withColumn("split", F.lit(None).cast("string"))
    span = bounds["high"] - bounds["low"]
    train_end = bounds["low"] + span * train_share
    val_end = train_end + span * val_share
    part = F.when(F.col(time) < train_end, "train").when(F.col(time) < val_end, "validation").otherwise("test")
    return frame.withColumn("split", part)


def split_user_tail(
    frame: DataFrame, order: Sequence[str], validation_ratio: float = 0.2, user: str = "visitorid"
) -> DataFrame:
    """The last share of every user's rows, at least one, for validation; the rest for training."""
    sizes = frame.groupBy(user).agg(F.count("*").alias("_rows"))
    numbered = Lanes(frame, [user], order).row_number("_nth").result()
    tail = F.greatest(F.lit(1), F.floor(F.col("_rows") * F.lit(validation_ratio)))
    part = F.when(F.col("_nth") > F.col("_rows") - tail, "validation").otherwise("train")
    return numbered.join(sizes, user).withColumn("split", part).drop("_rows", "_nth")


def cutoffs(split: DataFrame, time: str = "timestamp") -> DataFrame:
    """Last time of every part but test."""
    return split.filter(F.col("split") != "test").groupBy("split").agg(F.max(time).alias("cutoff"))


def split_summary(split: DataFrame, user: str = "visitorid", item: str = "itemid", time: str = "timestamp") -> DataFrame:
    """Start, end, rows, users and items of every part."""
    return split.groupBy("split").agg(
        F.min(time).alias("start_ms"),
        F.max(time).alias("end_ms"),
        F.count("*").alias("events"),
        F.count_distinct(user).alias("users"),
        F.count_distinct(item).alias("items"),
    )


def part(split: DataFrame, name: str) -> DataFrame:
    return split.filter(F.col("split") == name).drop("split")


def distinct_pairs(frame: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    return frame.select(user, item).distinct()


def warm_truth(train: DataFrame, test: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Held-out pairs whose user and item both occur in training."""
    pairs = distinct_pairs(test, user, item)
    for key in (user, item):
        pairs = pairs.join(train.select(key).distinct(), key, "left_semi")
    return pairs.select(user, item)


def evaluable_truth(train: DataFrame, test: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Warm pairs the user has not already seen in training."""
    return warm_truth(train, test, user, item).join(distinct_pairs(train, user, item), [user, item], "left_anti").select(user, item)


def weighted_truth(
    train: DataFrame, test: DataFrame, min_weight: float = 1, user: str = "visitorid", item: str = "itemid",
    weights: Mapping[str, float] = EVENT_WEIGHTS,
) -> DataFrame:
    """Held-out pairs of known users and items whose summed weight reaches ``min_weight``."""
    pairs = interaction_weights(test, user, item, upper=None, weights=weights).filter(F.col("weight") >= min_weight)
    for key in (user, item):
        pairs = pairs.join(train.select(key).distinct(), key, "left_semi")
    return pairs.select(user, item, "weight")


def warm_cold_users(train: DataFrame, test: DataFrame, user: str = "visitorid", digits: int = 2) -> DataFrame:
    """Users of the held-out part that training knows, and those it does not."""
    known = train.select(user).distinct().withColumn("_known", F.lit(1))
    users = test.select(user).distinct().join(known, user, "left")
    total, warm = F.count("*"), F.count("_known")
    pct = F.round(F.coalesce(F.lit(100.0) * warm / F.nullif(total, F.lit(0)), F.lit(0.0)), digits)
    return users.agg(warm.alias("warm_users"), (total - warm).alias("cold_users"), total.alias("users"), pct.alias("warm_pct"))


def truth_summary(truths: Mapping[str, DataFrame], user: str = "visitorid") -> DataFrame:
    """Evaluable users and mean items per user of each truth table."""
    parts = [
        t.groupBy(user).agg(F.count("*").alias("n")).agg(
            F.lit(name).alias("split"), F.count("*").alias("users"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("avg_items")
        )
        for name, t in truths.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def first_users(truth: DataFrame, max_users: int, user: str = "user_id") -> DataFrame:
    """Truth of the first ``max_users`` users by id; all of it when the cap is not positive."""
    if max_users <= 0:
        return truth
    chosen = truth.select(user).distinct().orderBy(user).limit(max_users)
    return truth.join(chosen, user, "left_semi")


def temporal_holdout(frame: DataFrame, test_ratio: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """Deduplicated interactions split by time: the training rows and the warm truth of the test part.

    Validation has the same share as test and is left out of both results.
    """
    named = resolve_columns(frame)
    require_columns(named, ["timestamp"])
    pairs = dedupe_first(named)
    split = split_three_way(pairs, ["timestamp", "user_id", "item_id"], test_ratio, test_ratio)
    train = part(split, "train")
    return train, warm_truth(train, part(split, "test"))
