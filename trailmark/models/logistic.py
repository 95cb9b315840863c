"""Logistic regression on user and item indicators, fitted by block coordinate Newton steps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.models.common import (
    ITEM,
    USER,
    check_limit,
    cold_users,
    item_counts,
    known_users,
    pairs_of,
    place_items,
    ranked_top,
    same_list,
    unseen_from,
)
from trailmark.operators.encoding import encode_ids, decode
from trailmark.operators.sampling import random_negatives
from trailmark.storage import materialise

STEP_LIMIT = 2.0


@dataclass
class LogisticModel:
    """score = intercept + user weight + item weight."""

    intercept: float
    users: DataFrame
    items: DataFrame
    steps: int
    change: float


def training_rows(train: DataFrame, negatives: int = 5, seed: int = 42) -> DataFrame:
    """Distinct positives and random non-positives as (user_id, item_id, label, n)."""
    encoded, users, items = encode_ids(pairs_of(train), USER, ITEM)
    pairs = materialise(encoded.select("user_index", "item_index"), "positives")
    drawn = random_negatives(pairs, users.count(), items.count(), negatives * pairs.count(), seed)
    labelled = pairs.withColumn("label", F.lit(1)).unionByName(
        drawn.select("user_index", "item_index").withColumn("label", F.lit(0))
    )
    counted = labelled.groupBy("user_index", "item_index", "label").agg(F.count("*").cast("double").alias("n"))
    return decode(decode(counted, users, "user_index", USER), items, "item_index", ITEM)


def fit_logistic(rows: DataFrame, c: float = 1.0, max_steps: int = 100, tolerance: float = 1e-5) -> LogisticModel:
    """Minimise 0.5 * |w|^2 + c * log-loss over intercept, user and item weights.

    Every row has one user and one item, so within the users (or the items) the
    Hessian is diagonal: a Newton step is one aggregation per key. Weights stay
    in tables keyed by id; nothing of the model passes through the driver but
    the intercept and the size of the last step.
    """
    rows = materialise(rows.select(USER, ITEM, "label", "n"), "rows")
    users = materialise(rows.select(USER).distinct().withColumn("w_user", F.lit(0.0)), "w-user")
    items = materialise(rows.select(ITEM).distinct().withColumn("w_item", F.lit(0.0)), "w-item")
    intercept, change, step = 0.0, float("inf"), 0
    moved_users, moved_items = users, items

    def slopes(intercept: float, users: DataFrame, items: DataFrame) -> DataFrame:
        score = F.lit(intercept) + F.col("w_user") + F.col("w_item")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-score))
        return rows.join(users, USER).join(items, ITEM).select(
            USER, ITEM, "w_user", "w_item", (F.col("n") * (p - F.col("label"))).alias("g"), (F.col("n") * p * (1 - p)).alias("h")
        )

    def newton(frame: DataFrame, key: str, weight: str, replaces: DataFrame) -> DataFrame:
        grad = F.first(weight) + F.lit(c) * F.sum("g")
        move = grad / (F.lit(1.0) + F.lit(c) * F.sum("h"))
        bounded = F.greatest(F.lit(-STEP_LIMIT), F.least(F.lit(STEP_LIMIT), move))
        moved = frame.groupBy(key).agg((F.first(weight) - bounded).alias(weight), F.abs(bounded).alias("move"))
        return materialise(moved, "weights", replaces=replaces)

    while step < max_steps and change > tolerance:
        step += 1
        shift = _common_shift(slopes(intercept, users, items), users, items, intercept, c)
        intercept -= float(shift[0])
        users = users.withColumn("w_user", F.col("w_user") - F.lit(float(shift[1])))
        items = items.withColumn("w_item", F.col("w_item") - F.lit(float(shift[2])))
        moved_users = newton(slopes(intercept, users, items), USER, "w_user", moved_users)
        users = moved_users.drop("move")
        moved_items = newton(slopes(intercept, users, items), ITEM, "w_item", moved_items)
        items = moved_items.drop("move")
        largest = moved_users.select("move").unionByName(moved_items.select("move")).agg(F.max("move")).first()[0]
        change = max(float(np.abs(shift).max()), largest)
    if change > tolerance:
        raise RuntimeError(f"no convergence in {step} steps: the last moved a weight by {change}")
    return LogisticModel(intercept, users, items, step, change)


def gradient(model: LogisticModel, rows: DataFrame, c: float = 1.0) -> DataFrame:
    """Absolute derivative of the objective at the model, per weight: (kind, id, gradient). All 0 at the minimum."""
    score = F.lit(model.intercept) + F.col("w_user") + F.col("w_item")
    joined = rows.join(model.users, USER).join(model.items, ITEM)
    told = joined.withColumn("g", F.col("n") * (F.lit(1.0) / (F.lit(1.0) + F.exp(-score)) - F.col("label")))
    slope = lambda weight: F.abs(weight + F.lit(c) * F.sum("g")).alias("gradient")
    by_user = told.groupBy(F.lit("user").alias("kind"), F.col(USER).alias("id")).agg(slope(F.first("w_user")))
    by_item = told.groupBy(F.lit("item").alias("kind"), F.col(ITEM).alias("id")).agg(slope(F.first("w_item")))
    whole = told.agg(slope(F.lit(model.intercept))).select(F.lit("intercept").alias("kind"), F.lit("").alias("id"), "gradient")
    return by_user.unionByName(by_item).unionByName(whole)


def _common_shift(rows: DataFrame, users: DataFrame, items: DataFrame, intercept: float, c: float) -> np.ndarray:
    """Newton step along three directions: intercept, all user weights together, all item weights together.

    These move the score of every row alike, so per-key steps alone trade them
    off very slowly. Solving the 3 x 3 system first removes that.
    """
    held = {f"{f.__name__}_{w}": table.agg(f(w)).scalar() for table, w in ((users, "w_user"), (items, "w_item")) for f in (F.count, F.sum)}
    sums = rows.agg(F.sum("g").alias("g"), F.sum("h").alias("h")).withColumns(held).first()
    g, h = sums["g"], sums["h"]
    gradient = np.array([intercept, sums["sum_w_user"], sums["sum_w_item"]]) + c * g
    curvature = np.diag([1.0, sums["count_w_user"], sums["count_w_item"]]) + c * h
    step = np.linalg.solve(curvature, gradient)
    return np.clip(step, -STEP_LIMIT, STEP_LIMIT)


def recommend_logistic(model: LogisticModel, train: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """Unseen items by decision value.

    Intercept and user weight are the same for all items of a user, so all
    users share one item order and only their unseen prefix of it is needed.
    """
    check_limit(k)
    warm = known_users(users, train)
    places = place_items(model.items.select(ITEM, F.col("w_item").alias("score")))
    ranked = unseen_from(places, warm, pairs_of(train), k)
    scored = ranked.join(model.users, USER).select(
        USER, ITEM, (F.lit(model.intercept) + F.col("w_user") + F.col("score")).alias("score"), "rank"
    )
    return scored.unionByName(same_list(cold_users(users, train), ranked_top(item_counts(pairs_of(train)), k)))


def logistic_regression(
    train: DataFrame, users: DataFrame, k: int = 10, negatives: int = 5, c: float = 1.0, max_steps: int = 100, seed: int = 42,
    tolerance: float = 1e-5,
) -> DataFrame:
    """Fit and recommend in one call."""
    model = fit_logistic(training_rows(train, negatives, seed), c, max_steps, tolerance)
    return recommend_logistic(model, train, users, k)
