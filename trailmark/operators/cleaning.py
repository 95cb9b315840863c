"""Row filters, normalisation, sampling, deduplication and the catalogue filter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.columns import EVENT_WEIGHTS, draw, event_time, event_weight
from trailmark.operators.ordering import dense_index, keys_at_ranks, split_at
from trailmark.storage import materialise

REQUIRED = ("timestamp", "visitorid", "event", "itemid")
TOP_LIST_ROWS = 100_000  # longest list sorted in one task and broadcast

# Column names accepted for the three roles, first match wins.
USER_ALIASES = ("visitorid", "user_id", "userId", "user")
ITEM_ALIASES = ("itemid", "item_id", "itemId", "item")
TIME_ALIASES = ("timestamp", "event_time", "time", "datetime", "ts")


def require_columns(frame: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(frame.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def keep_events(frame: DataFrame, names: Sequence[str], event: str = "event") -> DataFrame:
    return frame.filter(F.col(event).isin(*names))


def normalize_events(frame: DataFrame, weights: Mapping[str, float] = EVENT_WEIGHTS) -> DataFrame:
    """Drop incomplete and unweighted rows; string ids, weight and UTC event time. Keeps other columns."""
    require_columns(frame, REQUIRED)
    return keep_events(frame.na.drop(subset=list(REQUIRED)), list(weights)).withColumns(
        {
            "visitorid": F.col("visitorid").cast("string"),
            "itemid": F.col("itemid").cast("string"),
            "event": F.col("event").cast("string"),
            "event_weight": event_weight("event", weights),
            "event_time": event_time("timestamp"),
        }
    )


def sample_rows(frame: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Exactly ``n`` rows, the same ones on every run; everything when ``n`` is 0 or too large.

    ``key`` identifies a row. Rows are ranked by a keyed hash and cut at rank n.
    """
    total = frame.count()
    if n <= 0 or n >= total:
        return frame
    drawn = frame.withColumn("_draw", draw(seed, *(F.col(k).cast("string") for k in key)))
    return split_at(drawn, ["_draw", *key], [n], "_late", total).filter("_late = 0").select(*frame.columns)


def sample_entities(frame: DataFrame, entity: str, n: int, seed: int) -> DataFrame:
    """All rows of ``n`` sampled entities."""
    chosen = sample_rows(frame.select(entity).distinct(), n, seed, [entity])
    return frame.join(chosen, entity, "left_semi")


def first_from(frame: DataFrame, start_ms: int, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in time order at or after a start time."""
    later = frame.filter(F.col("timestamp") >= start_ms)
    total = later.count()
    if n <= 0 or n >= total:
        return later
    return split_at(later, order, [n], "_late", total).filter("_late = 0").drop("_late")


def top_keys(totals: DataFrame, key: str, measure: str, n: int) -> DataFrame:
    """The ``n`` keys with the largest measure, ties by key."""
    if n <= TOP_LIST_ROWS:
        return totals.orderBy(F.desc(measure), key).limit(n)
    ranked = totals.withColumn("_down", -F.col(measure))
    total = ranked.count()
    if n >= total:
        return totals
    return split_at(ranked, ["_down", key], [n], "_late", total).filter("_late = 0").select(*totals.columns)


def catalog_filter(
    frame: DataFrame,
    max_items: int = 10_000,
    min_per_user: int = 5,
    user: str = "visitorid",
    item: str = "itemid",
) -> DataFrame:
    """Keep the most frequent items, then users with enough rows, until nothing changes.

    Rounds run on row counts per (user, item), which is all they need; the event
    rows are read once at the end. 0 switches either limit off.
    """
    pairs = materialise(frame.groupBy(user, item).agg(F.count("*").alias("n")), "pairs")
    rows = _total(pairs)
    while True:
        before = pairs
        if max_items > 0:
            per_item = pairs.groupBy(item).agg(F.sum("n").alias("n"))
            pairs = pairs.join(top_keys(per_item, item, "n", max_items).select(item), item, "left_semi")
        if min_per_user > 0:
            active = pairs.groupBy(user).agg(F.sum("n").alias("n")).filter(F.col("n") >= min_per_user)
            pairs = pairs.join(active.select(user), user, "left_semi")
        pairs = materialise(pairs, "pairs", replaces=before)
        left = _total(pairs)
        if left == rows:
            break
        rows = left
    # a dropped item or user never returns, so the survivors are a product of both sides
    result = frame
    if max_items > 0:
        result = result.join(pairs.select(item).distinct(), item, "left_semi")
    if min_per_user > 0:
        result = result.join(pairs.select(user).distinct(), user, "left_semi")
    return result.select(*frame.columns)


def _total(pairs: DataFrame) -> int:
    return pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def dedupe_first(
    frame: DataFrame, keys: Sequence[str] = ("user_id", "item_id"), time: str | None = "timestamp", tie: Sequence[str] = ()
) -> DataFrame:
    """One row per key: the earliest by time (then ``tie``), or any copy without a time column.

    Aggregates before the shuffle, so a hot pair costs one row per task.
    """
    keys = list(keys)
    if time is None or time not in frame.columns:
        return frame.dropDuplicates(keys)
    others = [c for c in frame.columns if c not in keys]
    if others == [time]:
        return frame.groupBy(*keys).agg(F.min(time).alias(time)).select(*frame.columns)
    first = F.min_by(F.struct(*others), F.struct(time, *tie)).alias("_first")
    return frame.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*frame.columns)


def resolve_columns(frame: DataFrame) -> DataFrame:
    """Rename user, item and time columns from their known aliases, as string ids.

    Falls back to the first two columns when an alias is missing.
    """

    def first_match(aliases: Sequence[str]) -> str | None:
        return next((a for a in aliases if a in frame.columns), None)

    user, item, time = map(first_match, (USER_ALIASES, ITEM_ALIASES, TIME_ALIASES))
    if user is None or item is None:
        if len(frame.columns) < 2:
            raise ValueError(f"no user and item columns among {frame.columns}")
        user, item = frame.columns[:2]
    picked = [F.col(user).cast("string").alias("user_id"), F.col(item).cast("string").alias("item_id")]
    if time is not None:
        picked.append(F.col(time).alias("timestamp"))
    return frame.select(*picked)


def load_pairs(frame: DataFrame) -> DataFrame:
    """Resolved columns with one row per user and item, the earliest."""
    return dedupe_first(resolve_columns(frame))


def duplicate_count(frame: DataFrame) -> DataFrame:
    """Rows beyond the first copy of every distinct row."""
    per_row = frame.groupBy(*frame.columns).agg(F.count("*").alias("copies"))
    return per_row.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))


def number_events(frame: DataFrame, order: Sequence[str], name: str = "event_id") -> DataFrame:
    """1-based event number in a total order."""
    return dense_index(frame, order, name, start=1)


def fill_categories(counts: DataFrame, category: str, values: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per listed category in that order (column ``position``), zero where none was counted."""
    spark = counts.sparkSession
    wanted = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "position int, category string")
    wanted = wanted.withColumnRenamed("category", category)
    return wanted.join(counts, category, "left").select(
        "position", category, *(F.coalesce(m, F.lit(0)).alias(m) for m in measures)
    )
