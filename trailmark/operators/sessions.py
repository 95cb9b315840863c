"""Sessions, gaps, transitions and visitor paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions.columns import (
    FUNNEL,
    GAP_BREAKS_MIN,
    bin_label,
    is_event,
    minutes_between,
    outcome_signature,
    percent,
    right_closed_bin,
)
from trailmark.operators.ordering import Lanes, percentiles
from trailmark.operators.profiling import describe
from trailmark.storage import materialise

VISITOR_ORDER = ("timestamp", "itemid", "event", "event_id")


def with_previous(frame: DataFrame, order: Sequence[str] = VISITOR_ORDER) -> DataFrame:
    """Previous event and time of the same visitor, and the minutes in between."""
    lanes = Lanes(frame, ["visitorid"], order)
    lanes.neighbour({"previous_timestamp": "timestamp", "previous_event": "event"}, -1)
    return lanes.result().withColumn("minutes_since_previous", minutes_between("timestamp", "previous_timestamp"))


def with_next(frame: DataFrame, order: Sequence[str] = VISITOR_ORDER) -> DataFrame:
    """Next event, item and time of the same visitor, and the minutes in between."""
    lanes = Lanes(frame, ["visitorid"], order)
    lanes.neighbour({"next_timestamp": "timestamp", "next_event": "event", "next_itemid": "itemid"}, 1)
    return lanes.result().withColumn("minutes_to_next", minutes_between("next_timestamp", "timestamp"))


def sessionize(
    frame: DataFrame, gap_minutes: float = 30, purchase_ends: bool = True, order: Sequence[str] = VISITOR_ORDER
) -> DataFrame:
    """Number the sessions of every visitor from 1.

    A session starts at the first event, after a gap of at least ``gap_minutes``
    and, with ``purchase_ends``, at the first other event after a transaction.
    """
    lanes = Lanes(frame, ["visitorid"], order)
    lanes.neighbour({"_before": "timestamp", "_event_before": "event"}, -1)
    starts = F.col("_before").isNull() | (minutes_between("timestamp", "_before") >= gap_minutes)
    if purchase_ends:
        starts |= (F.col("_event_before") == "transaction") & (F.col("event") != "transaction")
    lanes.frame = lanes.frame.withColumn("_starts", starts.cast("long")).drop("_before", "_event_before")
    lanes.running_sum("session_index", "_starts")
    return (
        lanes.result()
        .drop("_starts")
        .withColumn("session_id", F.concat_ws("_", F.col("visitorid").cast("string"), F.col("session_index").cast("string")))
    )


def session_rule_comparison(frame: DataFrame, gap_minutes: float = 30) -> DataFrame:
    """Sessions by gap alone and with purchases ending a session; one pass over the gaps."""
    seen = with_previous(frame)
    first = F.col("previous_timestamp").isNull()
    gap = first | (F.col("minutes_since_previous") >= gap_minutes)
    bought = (F.col("previous_event") == "transaction") & (F.col("event") != "transaction")
    totals = seen.agg(F.count_if(gap).alias("gap_only"), F.count_if(gap | bought).alias("with_purchase"))
    return totals.select(
        F.inline(
            F.array(
                F.struct(F.lit("gap_only").alias("rule"), F.col("gap_only").alias("sessions"), F.lit(0).cast("bigint").alias("extra")),
                F.struct(
                    F.lit("gap_or_purchase").alias("rule"),
                    F.col("with_purchase").alias("sessions"),
                    (F.col("with_purchase") - F.col("gap_only")).alias("extra"),
                ),
            )
        )
    )


def session_table(sessions: DataFrame) -> DataFrame:
    """One row per session: events, duration in minutes, event types and purchase flag."""
    return sessions.groupBy("visitorid", "session_index", "session_id").agg(
        F.count("*").alias("n_events"),
        ((F.max("timestamp") - F.min("timestamp")) / F.lit(60000.0)).alias("duration_min"),
        F.array_join(F.array_sort(F.collect_set("event")), " ").alias("event_types"),
        F.max(is_event("event", "transaction")).alias("has_purchase"),
    )


def session_percentiles(table: DataFrame, method: str = "nearest") -> DataFrame:
    """Median, p90, p99 and maximum of session size, and of duration for sessions of several events."""
    longer = table.filter(F.col("n_events") > 1)
    rows = []
    for metric, frame in (("n_events", table), ("duration_min", longer)):
        # the median is the linear one; the upper percentiles follow ``method``
        middle = percentiles(frame, metric, [0.5])
        upper = percentiles(frame, metric, [0.9, 0.99, 1.0], method)
        rows += [
            (metric, "median", middle[0.5]),
            (metric, "p90", upper[0.9]),
            (metric, "p99", upper[0.99]),
            (metric, "max", upper[1.0]),
        ]
    result = table.sparkSession.createDataFrame(rows, "metric string, statistic string, value double")
    return result.withColumn("value", F.round("value", 6))


def gap_distribution(frame: DataFrame, breaks: Sequence[float] = GAP_BREAKS_MIN, digits: int = 2) -> DataFrame:
    """Gaps between consecutive events of a visitor, counted per bin with their share."""
    gaps = with_previous(frame).filter(F.col("minutes_since_previous").isNotNull())
    place = right_closed_bin("minutes_since_previous", breaks)
    bins = range(len(breaks) + 1)
    counted = gaps.agg(F.count("*").alias("all"), *(F.count_if(place == b).alias(f"b{b}") for b in bins))
    rows = [F.struct(F.lit(b).alias("bin"), F.col(f"b{b}").alias("gaps"), F.col("all")) for b in bins]
    return (
        counted.select(F.inline(F.array(*rows)))
        .filter(F.col("gaps") > 0)
        .select("bin", bin_label("bin", breaks).alias("gap_bin"), "gaps", percent(F.col("gaps"), F.col("all"), digits).alias("pct"))
    )


def session_sensitivity(frame: DataFrame, gaps_minutes: Sequence[int] = (30, 60)) -> DataFrame:
    """Estimated sessions for several gap thresholds, all from one pass."""
    seen = with_previous(frame)
    first = F.col("previous_timestamp").isNull()
    counted = seen.agg(
        F.count("*").alias("events"),
        *(F.count_if(first | (F.col("minutes_since_previous") >= g)).alias(f"s{g}") for g in gaps_minutes),
    )
    rows = [
        F.struct(F.lit(g).alias("gap_minutes"), F.col(f"s{g}").alias("sessions"), F.col("events").alias("events"))
        for g in gaps_minutes
    ]
    return counted.select(F.inline(F.array(*rows)))


def transitions(frame: DataFrame, events: Sequence[str] = FUNNEL, digits: int = 2) -> DataFrame:
    """Counts and row shares of event to next event, over all items and within the same item.

    Every cell of the event grid is present, zero where nothing was counted.
    """
    following = with_next(frame).filter(F.col("event").isin(*events) & F.col("next_event").isin(*events))
    counted = following.groupBy("event", "next_event").agg(
        F.count("*").alias("all_items"),
        F.count_if(F.col("itemid") == F.col("next_itemid")).alias("same_item"),
    )
    spark = frame.sparkSession
    grid = spark.createDataFrame([(a, b) for a in events for b in events], "event string, next_event string")
    filled = grid.join(F.broadcast(counted), ["event", "next_event"], "left").na.fill(0, ["all_items", "same_item"])
    row = Window.partitionBy("event")
    return filled.select(
        "event",
        "next_event",
        "all_items",
        percent(F.col("all_items"), F.sum("all_items").over(row), digits).alias("all_items_pct"),
        "same_item",
        percent(F.col("same_item"), F.sum("same_item").over(row), digits).alias("same_item_pct"),
    )


def ordered_items(frame: DataFrame, user: str, item: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """The items of every user in order, as rows numbered from 1."""
    return Lanes(frame.select(user, item, *(c for c in order if c not in (user, item))), [user], order).row_number(name).result()


def first_paths(frame: DataFrame, length: int = 8, order: Sequence[str] = VISITOR_ORDER) -> DataFrame:
    """The first ``length`` events of every visitor as one string.

    Only ``length`` rows per visitor and task reach the shuffle.
    """
    window = Window.partitionBy("visitorid").orderBy(*order)
    head = frame.withColumn("_step", F.row_number().over(window)).filter(F.col("_step") <= length)
    steps = F.array_sort(F.collect_list(F.struct("_step", "event")))
    return head.groupBy("visitorid").agg(F.array_join(F.transform(steps, lambda s: s["event"]), " > ").alias("path"))


def top_paths(frame: DataFrame, length: int = 8, n: int = 20) -> DataFrame:
    """The most common opening paths."""
    counts = first_paths(frame, length).groupBy("path").agg(F.count("*").alias("visitors"))
    return counts.orderBy(F.desc("visitors"), "path").limit(n)


def outcomes(frame: DataFrame, events: Sequence[str] = FUNNEL) -> DataFrame:
    """Per visitor: number of events, which event types occurred, and their signature."""
    flags = frame.groupBy("visitorid").agg(
        F.count("*").alias("n_events"), *(F.max(is_event("event", e)).alias(f"has_{e}") for e in events)
    )
    return flags.withColumn("signature", outcome_signature({e: F.col(f"has_{e}") for e in events}))


def outcome_counts(frame: DataFrame, events: Sequence[str] = FUNNEL) -> DataFrame:
    return outcomes(frame, events).groupBy("signature").agg(F.count("*").alias("visitors"))


def gap_profile(frame: DataFrame, fractions: Sequence[float] = (0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """Count, mean, deviation and percentiles of the minutes since the previous event, per event type."""
    seen = materialise(with_previous(frame).select("event", "minutes_since_previous"), "gaps")
    parts = [
        describe(seen.filter(F.col("event") == e), "minutes_since_previous", fractions).select(F.lit(e).alias("event"), "*")
        for e in FUNNEL
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
