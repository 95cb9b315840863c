"""The batch stages: raw events to interactions, to encoded and split features, to evaluated lists."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.columns import EVENT_WEIGHTS
from trailmark.operators import cleaning, encoding, sessions, splits
from trailmark.operators.ranking_metrics import METRICS, mean_metrics
from trailmark.storage import materialise

TIME_ORDER = ("timestamp", "visitorid", "itemid", "event", "event_id")


def preprocess(
    events: DataFrame, weights: Mapping[str, float] = EVENT_WEIGHTS, sample: int = 0, seed: int = 42,
    max_items: int = 10_000, min_per_user: int = 5, key: Sequence[str] = ("event_id",),
) -> DataFrame:
    """Optional sample, normalised events, then the catalogue filter."""
    rows = cleaning.sample_rows(events, sample, seed, key) if sample > 0 else events
    return cleaning.catalog_filter(cleaning.normalize_events(rows, weights), max_items, min_per_user)


@dataclass
class Features:
    """Encoded events with sessions and a ``split`` column, and the id tables."""

    events: DataFrame
    users: DataFrame
    items: DataFrame


def build_features(
    interactions: DataFrame, gap_minutes: float = 30, train_ratio: float = 0.70, val_ratio: float = 0.15, order: Sequence[str] = TIME_ORDER
) -> Features:
    """Sessions, dense ids fitted on all rows, and the chronological split by position."""
    with_sessions = sessions.sessionize(interactions, gap_minutes)
    encoded, users, items = encoding.encode_ids(with_sessions)
    stored = materialise(encoded, "features")
    return Features(splits.split_positional(stored, order, train_ratio, val_ratio), users, items)


def evaluate(
    recommend: Callable[[DataFrame, DataFrame, int], DataFrame], train: DataFrame, test: DataFrame, k: int = 10, max_users: int = 0
) -> DataFrame:
    """One row of metrics named ``<metric>_at_K`` with ``evaluated_users``.

    Only items of the training catalogue that the user has not seen count as
    relevant. All zeros when no user can be evaluated.
    """
    relevant = materialise(splits.first_users(splits.evaluable_truth(train, test), max_users), "relevant")
    users = relevant.select("user_id").distinct()
    wide = mean_metrics(recommend(train, users, k), relevant, [k])
    return wide.select(*(F.col(m).alias(f"{m}_at_{k}") for m in METRICS), F.col("num_users").cast("double").alias("evaluated_users"))
