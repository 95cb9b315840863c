"""Top-K ranking metrics over long recommendation and truth tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.ordering import running_totals

K_VALUES = (5, 10, 20)
METRICS = ("precision", "recall", "ndcg", "map", "hit_rate")


def _check(ks: Sequence[int]) -> None:
    if not ks or min(ks) < 1:
        raise ValueError("K must be at least 1")


def hit_ranks(recommendations: DataFrame, truth: DataFrame, max_k: int, user: str, item: str) -> DataFrame:
    """Per user present on both sides: the ascending hit ranks up to ``max_k`` and the number of true items.

    At most ``max_k`` ranks are gathered per user. An item recommended twice hits once.
    """
    best = recommendations.filter(F.col("rank") <= max_k).groupBy(user, item).agg(F.min("rank").alias("rank"))
    pairs = truth.select(user, item).distinct()
    hits = best.join(pairs.withColumn("_hit", F.lit(1)), [user, item], "left")
    ranks = hits.groupBy(user).agg(F.array_sort(F.collect_list(F.when(F.col("_hit") == 1, F.col("rank")))).alias("ranks"))
    return ranks.join(pairs.groupBy(user).agg(F.count("*").alias("relevant")), user)


def _gain(k: int) -> list[float]:
    """Ideal DCG for 1..k true items."""
    total, result = 0.0, []
    for position in range(1, k + 1):
        total += 1.0 / math.log2(position + 1)
        result.append(total)
    return result


def _metric_columns(k: int) -> dict[str, Column]:
    hits = F.filter("ranks", lambda r: r <= k)
    found = F.size(hits).cast("double")
    reachable = F.least(F.col("relevant"), F.lit(k)).cast("int")
    gain = F.aggregate(hits, F.lit(0.0), lambda acc, r: acc + F.lit(1.0) / F.log2(r + F.lit(1.0)))
    at_hit = F.transform(hits, lambda r, i: (i + F.lit(1.0)) / r)
    precision_sum = F.aggregate(at_hit, F.lit(0.0), lambda acc, p: acc + p)
    ideal = F.element_at(F.array(*map(F.lit, _gain(k))), reachable)
    return {
        "precision": found / F.lit(float(k)),
        "recall": found / F.col("relevant"),
        "ndcg": gain / ideal,
        "map": precision_sum / reachable,
        "hit_rate": (found > 0).cast("double"),
    }


def per_user_metrics(
    recommendations: DataFrame, truth: DataFrame, ks: Sequence[int] = K_VALUES, user: str = "user_id", item: str = "item_id"
) -> DataFrame:
    """Long table (user, k, precision, recall, ndcg, map, hit_rate)."""
    _check(ks)
    ranks = hit_ranks(recommendations, truth, max(ks), user, item)
    rows = [F.struct(F.lit(k).alias("k"), *(c.alias(m) for m, c in _metric_columns(k).items())) for k in ks]
    return ranks.select(user, F.inline(F.array(*rows)))


def mean_metrics(
    recommendations: DataFrame, truth: DataFrame, ks: Sequence[int] = K_VALUES, user: str = "user_id", item: str = "item_id",
    digits: int | None = None,
) -> DataFrame:
    """Wide report, one row per K: means over users with truth and recommendations, and the size of the truth.

    Means are 0 when no user has both.
    """
    scores = per_user_metrics(recommendations, truth, ks, user, item)

    def mean(metric: str) -> Column:
        value = F.coalesce(F.avg(metric), F.lit(0.0))
        return (value if digits is None else F.round(value, digits)).alias(metric)

    grid = truth.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    means = scores.groupBy("k").agg(*map(mean, METRICS), F.count("*").alias("evaluated_users"))
    users = truth.agg(F.count_distinct(user)).scalar()
    return (
        grid.join(F.broadcast(means), "k", "left")
        .na.fill(0.0, list(METRICS))
        .na.fill(0, ["evaluated_users"])
        .withColumn("num_users", users)
    )


def long_metrics(wide: DataFrame) -> DataFrame:
    """(metric, k, value) rows named ``metric@K``, plus ``num_users``; other columns ride along."""
    others = [c for c in wide.columns if c not in (*METRICS, "k", "num_users", "evaluated_users")]
    rows = [
        F.struct(F.concat(F.lit(f"{m}@"), F.col("k").cast("string")).alias("metric"), F.col("k").alias("k"), F.col(m).alias("value"))
        for m in METRICS
    ]
    users = F.struct(F.lit("num_users").alias("metric"), F.lit(None).cast("int").alias("k"), F.col("num_users").cast("double").alias("value"))
    return wide.select(*others, F.inline(F.array(*rows, users))).distinct()


def catalogue_coverage(
    recommendations: DataFrame, catalogue: DataFrame, ks: Sequence[int] = K_VALUES, item: str = "item_id", digits: int | None = None
) -> DataFrame:
    """Share of the catalogue that appears in any list, per K; each item counts from its best rank on."""
    _check(ks)
    best = recommendations.groupBy(item).agg(F.min("rank").alias("rank"))
    items = catalogue.agg(F.count_distinct(item)).scalar()
    counted = best.agg(*(F.count_if(F.col("rank") <= k).alias(f"k{k}") for k in ks))
    rows = [F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("items")) for k in ks]
    share = F.coalesce(F.col("items") / F.nullif(items, F.lit(0)), F.lit(0.0))
    return counted.select(F.inline(F.array(*rows))).withColumn("coverage", share if digits is None else F.round(share, digits))


def auc(scored: DataFrame, score: str = "score", label: str = "label", digits: int | None = None) -> DataFrame:
    """Exact area under the ROC curve; 0.5 when only one class is present.

    Rows are counted per score first; running totals over the scores then count
    the negatives below each one, ties half.
    """
    per_score = scored.groupBy(score).agg(
        F.count_if(F.col(label) > 0).alias("_pos"), F.count_if(F.col(label) <= 0).alias("_neg")
    )
    ranked = running_totals(per_score, [score], {"_neg_upto": "_neg"})
    below = F.col("_neg_upto") - F.col("_neg") * F.lit(0.5)
    totals = ranked.agg(
        F.sum(F.col("_pos") * below).alias("_won"), F.coalesce(F.sum("_pos"), F.lit(0)).alias("positives"), F.coalesce(F.sum("_neg"), F.lit(0)).alias("negatives")
    )
    value = F.coalesce(F.col("_won") / F.nullif(F.col("positives").cast("double") * F.col("negatives"), F.lit(0.0)), F.lit(0.5))
    return totals.select("positives", "negatives", (value if digits is None else F.round(value, digits)).alias("auc"))


def compare_lists(
    first: DataFrame, second: DataFrame, truth: DataFrame, user: str = "user_id", item: str = "item_id"
) -> DataFrame:
    """Two recommendation tables side by side by rank, each item flagged when it is in the truth."""
    known = truth.select(user, item).distinct().withColumn("_hit", F.lit(1))

    def flagged(recommendations: DataFrame, suffix: str) -> DataFrame:
        return recommendations.join(known, [user, item], "left").select(
            user, "rank", F.col(item).alias(f"item_{suffix}"), F.coalesce("_hit", F.lit(0)).alias(f"in_truth_{suffix}")
        )

    return flagged(first, "a").join(flagged(second, "b"), [user, "rank"], "full")


def stack_results(results: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Metric tables of several (model, split) runs in one table."""
    parts = [wide.select(F.lit(m).alias("model"), F.lit(s).alias("split"), "*") for (m, s), wide in results.items()]
    return reduce(DataFrame.unionByName, parts)
