"""Point-in-time lookups of item properties and the event super table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.columns import FUNNEL, date_parts, is_event, lenient_long, minutes_between, percent
from trailmark.operators.cleaning import number_events
from trailmark.operators.ordering import Lanes, running_totals
from trailmark.operators.profiling import membership_rate, metric_rows
from trailmark.storage import materialise

EVENT_ORDER = ("timestamp", "visitorid", "itemid", "event")
ASOF_PROPERTIES = {"categoryid": "categoryid_asof", "available": "available_asof"}


def _item_timeline(events: DataFrame, changes: DataFrame, properties: Sequence[str], event_key: str) -> Lanes:
    """Events and property changes of every item in one ordered table; changes come first at equal times."""
    side = changes.filter(F.col("property").isin(*properties) & F.col("itemid").isNotNull() & F.col("timestamp").isNotNull())
    stacked = events.withColumns({"_side": F.lit(1), "_tie": F.col(event_key), "_is_event": F.lit(1)}).unionByName(
        side.select(
            "timestamp", "itemid", "property", "value", F.lit(0).alias("_side"), F.col("change_id").alias("_tie"), F.lit(0).alias("_is_event")
        ),
        allowMissingColumns=True,
    )
    stacked = stacked.withColumns(
        {
            f"_{p}": F.when(F.col("property") == p, F.struct(F.col("value"), F.col("timestamp").alias("time")))
            for p in properties
        }
    ).drop("property", "value")
    return Lanes(stacked, ["itemid"], ["timestamp", "_side", "_tie"])


def _unpack(frame: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    for prop, name in columns.items():
        frame = frame.withColumns({name: F.col(f"_known_{prop}.value"), f"{name}_time": F.col(f"_known_{prop}.time")})
    return frame.drop(*(f"_known_{p}" for p in columns), *(f"_{p}" for p in columns), "_side", "_tie", "_is_event")


def asof_properties(
    events: DataFrame, changes: DataFrame, columns: Mapping[str, str] = ASOF_PROPERTIES, event_key: str = "event_id"
) -> DataFrame:
    """Every event with the latest property value of its item at or before the event time.

    All properties are looked up in one pass: both tables are stacked and
    shuffled once by item. Adds ``<column>`` and ``<column>_time``; null where
    nothing was known yet. Equal change times resolve to the largest change id.
    """
    lanes = _item_timeline(events, changes, list(columns), event_key)
    lanes.last_known({f"_known_{p}": f"_{p}" for p in columns})
    return _unpack(lanes.result().filter("_side = 1"), columns).select(
        *events.columns, *(c for name in columns.values() for c in (name, f"{name}_time"))
    )


def latest_property(changes: DataFrame, prop: str, name: str) -> DataFrame:
    """The newest value of one property per item."""
    newest = F.max_by("value", F.struct("timestamp", "change_id")).alias(name)
    return changes.filter(F.col("property") == prop).groupBy("itemid").agg(newest)


def with_history(frame: DataFrame, order: Sequence[str]) -> DataFrame:
    """Earlier events of the same user and of the same item, counted per row."""
    by_user = Lanes(frame, ["visitorid"], order).row_number("_nth_user").result()
    by_item = Lanes(by_user, ["itemid"], order).row_number("_nth_item").result()
    return by_item.withColumns(
        {"user_events_before": F.col("_nth_user") - 1, "item_events_before": F.col("_nth_item") - 1}
    ).drop("_nth_user", "_nth_item")


def super_event_table(
    events: DataFrame, changes: DataFrame, tree: DataFrame, order: Sequence[str] = (*EVENT_ORDER, "source_id")
) -> DataFrame:
    """One row per event with targets, time parts, properties known at the time, and user and item history.

    Three shuffles: by time for the event number, by user, and by item - the
    item pass serves both the history and the property lookups.
    """
    numbered = number_events(events, order)
    users = Lanes(numbered, ["visitorid"], ["event_id"]).neighbour({"_user_time": "timestamp"}, -1).row_number("_nth_user")
    items = _item_timeline(users.result().withColumn("_event_time", F.col("timestamp")), changes, list(ASOF_PROPERTIES), "event_id")
    items.last_known({f"_known_{p}": f"_{p}" for p in ASOF_PROPERTIES})
    items.last_known({"_item_time": "_event_time"}, inclusive=False)
    items.running_sum("_nth_item", "_is_event")
    rows = _unpack(items.result().filter("_side = 1"), ASOF_PROPERTIES)
    rows = rows.withColumns({name: lenient_long(name) for name in ASOF_PROPERTIES.values()})
    parents = tree.select(F.col("categoryid").alias("categoryid_asof"), F.col("parentid").alias("category_parentid"))
    rows = rows.withColumn("event_time", F.timestamp_millis("timestamp")).join(parents, "categoryid_asof", "left")
    return rows.select(
        "event_id",
        "timestamp",
        "event_time",
        "visitorid",
        "event",
        "itemid",
        "transactionid",
        is_event("event", "transaction").alias("target_transaction"),
        is_event("event", "addtocart", "transaction").alias("target_addtocart_or_transaction"),
        *(c.alias(n) for n, c in date_parts("event_time").items()),
        "categoryid_asof",
        "categoryid_asof_time",
        "category_parentid",
        "available_asof",
        "available_asof_time",
        (F.col("_nth_user") - 1).alias("user_events_before"),
        minutes_between("timestamp", "_user_time").alias("user_minutes_since_previous"),
        (F.col("_nth_item") - 1).alias("item_events_before"),
        minutes_between("timestamp", "_item_time").alias("item_minutes_since_previous"),
    )


def preview(table: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` events with known properties and the first ``n`` overall, without repeats."""
    known = table.filter(F.col("categoryid_asof").isNotNull() | F.col("available_asof").isNotNull())
    return known.orderBy("event_id").limit(n).unionByName(table.orderBy("event_id").limit(n)).dropDuplicates(["event_id"])


def join_audit(table: DataFrame, tree: DataFrame, digits: int = 2) -> DataFrame:
    """Checks of the super table: rows, key uniqueness, fill rates, future values and known categories."""
    known = tree.select(F.col("categoryid").alias("_tree")).distinct()
    keys = table.groupBy("event_id").agg(F.count("*").alias("n"))
    unique = keys.agg((F.coalesce(F.max("n"), F.lit(0)) <= 1).cast("int")).scalar()
    filled = {c: F.count(c) for c in ASOF_PROPERTIES.values()}
    audit = table.join(known, F.col("categoryid_asof") == F.col("_tree"), "left").agg(
        F.count("*").alias("event_rows"),
        *(percent(n, F.count("*"), digits).alias(f"{c}_filled_pct") for c, n in filled.items()),
        *(F.count_if(F.col(f"{c}_time") > F.col("timestamp")).alias(f"{c}_future_rows") for c in filled),
        percent(F.count("_tree"), F.count("categoryid_asof"), digits).alias("category_in_tree_pct"),
    )
    return audit.withColumn("event_id_unique", unique)


def missing_share(table: DataFrame, digits: int = 2) -> DataFrame:
    """Percent of nulls per column, from one aggregate row."""
    counted = table.agg(F.count("*").alias("_rows"), *(F.count(c).alias(c) for c in table.columns))
    rows = [
        F.struct(F.lit(c).alias("field"), percent(F.col("_rows") - F.col(c), F.col("_rows"), digits).alias("null_pct"))
        for c in table.columns
    ]
    return counted.select(F.inline(F.array(*rows)))


def feature_readiness(
    events: DataFrame, order: Sequence[str] = (*EVENT_ORDER, "event_id"), digits: int = 2
) -> DataFrame:
    """Share of rows without user, item or any history, and the p95 of prior counts.

    A row lacks history exactly when it is the first of its key, so minima per
    user and per item answer this without numbering rows.
    """
    first = F.min(F.struct(*order)).alias("first")
    by_user, by_item = (events.groupBy(key).agg(first).select("first") for key in ("visitorid", "itemid"))
    rows, users, items, both = (F.col(c) for c in ("events", "_users", "_items", "_both"))
    counted = events.agg(F.count("*").alias("events")).withColumns(
        {
            "_users": by_user.agg(F.count("*")).scalar(),
            "_items": by_item.agg(F.count("*")).scalar(),
            "_both": by_user.join(by_item, "first").agg(F.count("*")).scalar(),
        }
    )
    p95 = {f"p95_{c}": prior_count_percentile(events, key, 0.95) for c, key in (("user_events_before", "visitorid"), ("item_events_before", "itemid"))}
    return counted.select(
        "events",
        percent(users, rows, digits).alias("no_user_history_pct"),
        percent(items, rows, digits).alias("no_item_history_pct"),
        percent(rows - users - items + both, rows, digits).alias("both_histories_pct"),
        *(F.lit(v).cast("double").alias(n) for n, v in p95.items()),
    )


def prior_count_percentile(events: DataFrame, key: str, fraction: float) -> float | None:
    """Percentile of the number of earlier rows with the same key, from group sizes alone.

    A key with s rows contributes the counts 0..s-1. Over the histogram of sizes
    in order, with K keys of which A are smaller than s and hold S rows, the rows
    of a count below s are S + (K - A) * s; the first size at which this passes a
    rank holds it. The sums are formed over a range shuffle, so that the
    number of distinct sizes is not bounded by the driver.
    """
    sizes = events.groupBy(key).agg(F.count("*").alias("s")).groupBy("s").agg(F.count("*").alias("keys"))
    placed = running_totals(sizes.withColumn("held", F.col("s") * F.col("keys")), ["s"], {"_keys": "keys", "_held": "held"})
    stored = materialise(placed, "sizes")
    keys, rows = stored.agg(F.max("_keys"), F.max("_held")).first()
    if not rows:
        return None
    alive, before = F.lit(keys) - F.col("_keys") + F.col("keys"), F.col("_held") - F.col("held")
    place = fraction * (rows - 1)
    ranks = [int(place), min(int(place) + 1, rows - 1)]
    at = F.struct("s", alive.alias("alive"), before.alias("before"))
    found = stored.agg(*(F.min(F.when(before + alive * F.col("s") > rank, at)) for rank in ranks)).first()
    low, high = ((rank - f["before"]) // f["alive"] for rank, f in zip(ranks, found))
    return low + (high - low) * (place - ranks[0])


def category_conversion(events: DataFrame, changes: DataFrame, tree: DataFrame, digits: int = 2) -> DataFrame:
    """Funnel counts per latest known category, with conversion, share of events and parent.

    Events shrink to counts per item before they meet the property table.
    """
    counts = {e: F.count_if(F.col("event") == e).alias(e) for e in FUNNEL}
    per_item = events.groupBy("itemid").agg(*counts.values())
    category = latest_property(changes, "categoryid", "_value").select("itemid", lenient_long("_value").alias("categoryid"))
    per_category = (
        per_item.join(category, "itemid")
        .filter(F.col("categoryid").isNotNull())
        .groupBy("categoryid")
        .agg(*(F.sum(e).alias(e) for e in FUNNEL))
        .withColumn("total", F.col("view") + F.col("addtocart") + F.col("transaction"))
    )
    everything = events.agg(F.count("*")).scalar()
    rate = F.coalesce(F.col("transaction") / F.nullif(F.col("view"), F.lit(0)), F.lit(0.0))
    return per_category.join(tree.withColumnRenamed("parentid", "category_parentid"), "categoryid", "left").select(
        "categoryid",
        *FUNNEL,
        "total",
        F.round(rate, 6).alias("transaction_per_view"),
        percent(F.col("total"), everything, digits).alias("events_pct"),
        "category_parentid",
    )


def coverage_summary(events: DataFrame, changes: DataFrame, tree: DataFrame, digits: int = 2) -> DataFrame:
    """Entity counts of the three tables and how many events concern items with known properties."""

    def distinct(frame: DataFrame, column: str):
        return frame.agg(F.count_distinct(column)).scalar()

    by_property = {p: changes.filter(F.col("property") == p) for p in ASOF_PROPERTIES}
    measures = {
        "items_in_events": distinct(events, "itemid"),
        "items_in_properties": distinct(changes, "itemid"),
        **{f"items_with_{p}": distinct(f, "itemid") for p, f in by_property.items()},
        "events_item_in_properties_pct": membership_rate(events, "itemid", changes, "itemid", digits),
        **{f"events_item_with_{p}_pct": membership_rate(events, "itemid", f, "itemid", digits) for p, f in by_property.items()},
        "categories_in_tree": distinct(tree, "categoryid"),
        "visitors": distinct(events, "visitorid"),
    }
    return metric_rows(events, measures)
