"""Model comparison, champion selection, promotion gate and batch inference."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.models import ease, latent, logistic, neighbours, neural, pairwise, simple
from trailmark.models.common import ITEM, USER, as_lists
from trailmark.operators.ranking_metrics import K_VALUES, catalogue_coverage, mean_metrics
from trailmark.operators.splits import first_users
from trailmark.storage import materialise

CHAMPION_K = 10
GATE_TOLERANCE = 0.05
RANKED_METRICS = ("precision", "recall", "ndcg", "map")

Recommender = Callable[[DataFrame, DataFrame, int], DataFrame]

# Role of each model in a comparison, by registered name.
ROLES = {
    "popularity": "baseline",
    "recent_items": "baseline",
    "random": "baseline",
    "item_knn": "baseline",
    "logistic_regression": "baseline",
    "ease": "challenger",
    "latent": "challenger",
    "pairwise": "challenger",
    "neural": "challenger",
    "neural_rerank": "challenger",
}


def _counted(train: DataFrame) -> DataFrame:
    return train.groupBy(USER, ITEM).agg(F.count("*").cast("double").alias("weight"))


def model_registry(rank: int = 64) -> dict[str, Recommender]:
    """Every model as a function (train, users, k) -> recommendations."""
    return {
        "popularity": lambda train, users, k: simple.popularity(train, users, k),
        "recent_items": lambda train, users, k: simple.recent_items(train, users, k),
        "random": lambda train, users, k: simple.random_items(train, users, k),
        "item_knn": lambda train, users, k: neighbours.item_knn(train, users, k),
        "logistic_regression": lambda train, users, k: logistic.logistic_regression(train, users, k),
        "ease": lambda train, users, k: ease.ease(train, users, k),
        "latent": lambda train, users, k: latent.recommend_latent(latent.fit_latent(_counted(train), rank), users, k),
        "pairwise": lambda train, users, k: latent.recommend_latent(pairwise.fit_pairwise(train, rank), users, k),
        "neural": lambda train, users, k: neural.recommend_neural(neural.fit_neural(train, max(1, rank // 2)), users, k),
        "neural_rerank": lambda train, users, k: latent.neural_rerank(train, _counted(train), users, k, rank),
    }


def harmonic_mean(metrics: Sequence[str] = RANKED_METRICS) -> Column:
    """Harmonic mean of the metric columns; 0 as soon as one is missing or not positive."""
    values = [F.coalesce(F.col(m), F.lit(0.0)) for m in metrics]
    usable = reduce(Column.__and__, (v > 0 for v in values))
    inverse = reduce(Column.__add__, (F.lit(1.0) / F.when(v > 0, v) for v in values))
    return F.when(usable, F.lit(float(len(metrics))) / inverse).otherwise(F.lit(0.0))


def compare_models(
    train: DataFrame, truth: DataFrame, models: Mapping[str, Recommender], ks: Sequence[int] = K_VALUES, max_users: int = 0,
    skip: Sequence[str] = (), report_failures: bool = False, at_once: int = 1,
) -> DataFrame:
    """Metrics of every model on the same users: (model, role, status, reason, seconds, k, metrics, coverage, users).

    Each model's lists are stored before scoring. A model that fails raises, or
    with ``report_failures`` gives one row with status ``failed``, the reason and
    no metrics. ``seconds`` is the time to fit and recommend. ``max_users`` caps the
    evaluated users, 0 takes all. ``at_once`` models share the cluster, so that steps of a
    few tasks do not leave it idle; their ``seconds`` are then those of a shared cluster.
    """
    train, truth = materialise(train, "train"), materialise(first_users(truth, max_users, USER), "truth")
    users, catalogue = truth.select(USER).distinct(), train.select(ITEM)

    def measured(name: str, recommend: Recommender) -> DataFrame:
        start = time.perf_counter()
        told = [F.lit(name).alias("model"), F.lit(ROLES.get(name, "custom")).alias("role")]
        try:
            lists = materialise(recommend(train, users, max(ks)), "lists")
            seconds = time.perf_counter() - start
            scores = mean_metrics(lists, truth, ks, USER, ITEM)
            spread = catalogue_coverage(lists, catalogue, ks, ITEM).select("k", "coverage")
            wide = scores.join(F.broadcast(spread), "k")
            done = [F.lit("done").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(seconds).alias("seconds")]
            # a row per K, kept in that order
            return materialise(wide.select(*told, *done, "*").repartition(1).sortWithinPartitions("k"), "metrics")
        except Exception as error:
            if not report_failures:
                raise
            row = [F.lit("failed").alias("status"), F.lit(f"{type(error).__name__}: {error}"[:500]).alias("reason"), F.lit(time.perf_counter() - start).alias("seconds")]
            return train.sparkSession.range(1).select(*told, *row)

    with ThreadPoolExecutor(at_once) as pool:
        # each task gets its own copy of the session's job properties
        todo = [(name, recommend) for name, recommend in models.items() if name not in skip]
        waiting = [pool.submit(inheritable_thread_target(train.sparkSession)(measured), *of) for of in todo]
        try:
            results = [task.result() for task in waiting]
        except BaseException:
            pool.shutdown(cancel_futures=True)
            raise
    if not results:
        raise ValueError("no model to compare")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)


def trade_off(metrics: DataFrame, k: int = CHAMPION_K, cost: str = "seconds") -> DataFrame:
    """Quality against a cost column: model, role, harmonic mean at K, cost, and whether a model both better and cheaper exists.

    Of models with equal cost the better one counts as the cheaper.
    """
    scored = metrics.filter(F.col("k") == k).withColumn("harmonic_mean", harmonic_mean()).select("model", "role", "k", "harmonic_mean", cost)
    cheaper = Window.partitionBy("k").orderBy(cost, F.desc("harmonic_mean")).rowsBetween(Window.unboundedPreceding, -1)
    beaten = F.coalesce(F.max("harmonic_mean").over(cheaper) > F.col("harmonic_mean"), F.lit(False))
    return scored.withColumn("dominated", beaten).drop("k")


def rank_models(metrics: DataFrame, k: int = CHAMPION_K) -> DataFrame:
    """Models by harmonic mean at K with their place and their lead over the next one.

    One row per model; the window is keyed by K.
    """
    scored = metrics.filter(F.col("k") == k).withColumn("harmonic_mean", harmonic_mean())
    order = Window.partitionBy("k").orderBy(F.desc("harmonic_mean"), "model")
    following = F.lead("harmonic_mean").over(order)
    gain = F.col("harmonic_mean") - following
    return scored.withColumn("place", F.row_number().over(order)).withColumns(
        {"absolute_gain": gain, "relative_gain": gain / F.nullif(following, F.lit(0.0))}
    )


def champion(ranked: DataFrame) -> DataFrame:
    return ranked.filter(F.col("place") == 1)


def runner_up(ranked: DataFrame) -> DataFrame:
    return ranked.filter(F.col("place") == 2)


def comparison_table(metrics: DataFrame, ks: Sequence[int] = K_VALUES) -> DataFrame:
    """One row per model with a column per metric and K, best harmonic mean at 10 first when sorted by ``place``."""
    named = [f"{m}_at_{k}" for m in (*RANKED_METRICS, "hit_rate") for k in ks]
    columns = [
        F.max(F.when(F.col("k") == k, F.col(m))).alias(f"{m}_at_{k}") for m in (*RANKED_METRICS, "hit_rate") for k in ks
    ]
    wide = metrics.groupBy("model").agg(*columns)
    ranked = rank_models(metrics).select("model", F.col("harmonic_mean").alias("harmonic_mean_at_10"), "place")
    return wide.join(ranked, "model").select("place", "model", "harmonic_mean_at_10", *named)


def best_logged_run(runs: DataFrame, prefix: str = "compare_") -> DataFrame:
    """Best run of a run table (run_name, has_artifact, metrics) among comparison runs with an artefact."""
    usable = runs.filter(F.col("run_name").startswith(prefix) & F.col("has_artifact"))
    return usable.withColumn("harmonic_mean", harmonic_mean()).orderBy(F.desc("harmonic_mean"), "run_name").limit(1)


def promotion_gate(candidate: DataFrame, reference: float | None, tolerance: float = GATE_TOLERANCE, dry_run: bool = False) -> DataFrame:
    """Decide on a candidate's one-row ``harmonic_mean`` against a reference value.

    The relative difference may not exceed the tolerance in either direction; a
    reference of 0 or less fails, a missing one passes. A dry run evaluates only.
    """
    observed, ref = F.col("observed"), F.lit(reference).cast("double")
    difference = F.abs(observed - ref) / F.nullif(ref, F.lit(0.0))
    reason = (
        F.when(ref.isNull(), "no reference")
        .when(ref <= 0, "reference not positive")
        .when(difference > tolerance, "outside tolerance")
        .otherwise("within tolerance")
    )
    passed = ref.isNull() | ((ref > 0) & (difference <= tolerance))
    return candidate.select(F.col("harmonic_mean").alias("observed")).select(
        "observed",
        ref.alias("reference"),
        F.when(ref > 0, difference).alias("relative_diff"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        (F.coalesce(passed, F.lit(False)) & F.lit(not dry_run)).alias("promoted"),
        reason.alias("reason"),
    )


def batch_recommend(
    users: DataFrame, recommend: Callable[..., DataFrame], default_limit: int = 10, limits_as_data: bool = False
) -> DataFrame:
    """Recommendation arrays for a user frame with an optional ``limit`` column.

    The first column is taken as the user when none is called ``user_id``. A
    missing or null limit means the default. ``recommend`` takes users and a list
    length; with ``limits_as_data`` it takes rows (user_id, limit) once, whatever limits there are.
    """
    if USER not in users.columns:
        users = users.withColumnRenamed(users.columns[0], USER)
    limit = F.coalesce(F.col("limit").cast("int"), F.lit(default_limit)) if "limit" in users.columns else F.lit(default_limit)
    wanted = users.select(F.col(USER).cast("string").alias(USER), limit.alias("_limit"))
    most = wanted.groupBy(USER).agg(F.max("_limit").alias("_limit"))
    if limits_as_data:
        lists = recommend(most.select(USER, F.col("_limit").alias("limit")))
    else:
        # users are served in classes of doubling limits, so that a long wish does not lengthen the lists of all others
        most = materialise(most.withColumn("_class", F.ceil(F.log2(F.greatest(F.col("_limit"), F.lit(1)))).cast("int")), "limits")
        classes = sorted(r["_class"] for r in most.select("_class").distinct().collect())
        parts = [recommend(most.filter(F.col("_class") == c).select(USER), 2**c) for c in classes]
        lists = reduce(DataFrame.unionByName, parts or [recommend(most.select(USER), default_limit)])
    cut = lists.join(most, USER).filter(F.col("rank") <= F.col("_limit"))
    return wanted.select(USER).join(as_lists(cut), USER, "left").select(
        USER, F.coalesce("recommendations", F.array().cast("array<string>")).alias("recommendations")
    )
