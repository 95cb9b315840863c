"""Counts, shares, distributions and summaries of event tables.

Shares divide by a scalar subquery or a value of the same one-row aggregate, so
no total is joined back and no window spans the whole table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions.columns import (
    EVENT_WEIGHTS,
    FUNNEL,
    WEEKDAYS,
    behaviour_profile,
    clip,
    event_weight,
    is_event,
    percent,
)
from trailmark.operators.cleaning import fill_categories
from trailmark.operators.ordering import join_keys, percentiles
from trailmark.storage import materialise


def value_counts(frame: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """Rows per value with their share of all rows."""
    total = frame.agg(F.count("*")).scalar()
    counts = frame.groupBy(column).agg(F.count("*").alias("n"))
    return counts.select(column, "n", percent(F.col("n"), total, digits).alias("pct"))


def group_sizes(frame: DataFrame, key: str, name: str = "n") -> DataFrame:
    return frame.groupBy(key).agg(F.count("*").alias(name))


def top_counts(frame: DataFrame, key: str, n: int, name: str = "n") -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return group_sizes(frame, key, name).orderBy(F.desc(name), key).limit(n)


def null_counts_by(frame: DataFrame, group: str, column: str) -> DataFrame:
    return frame.groupBy(group, F.col(column).isNull().alias("is_null")).agg(F.count("*").alias("n"))


def sparsity(frame: DataFrame, user: str = "visitorid", item: str = "itemid", by_rows: bool = False) -> DataFrame:
    """Users, items, distinct pairs and the empty share of the user-item matrix.

    ``by_rows`` counts every row as a cell. Distinct counts run over the pair
    table, which is aggregated first.
    """
    pairs = frame.groupBy(user, item).agg(F.count("*").alias("n"))
    counted = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
        F.count_distinct(user).alias("users"),
        F.count_distinct(item).alias("items"),
        F.count("*").alias("pairs"),
    )
    cells = F.col("events") if by_rows else F.col("pairs")
    empty = F.lit(1.0) - cells / F.nullif(F.col("users") * F.col("items"), F.lit(0))
    return counted.withColumn("sparsity", F.round(F.coalesce(empty, F.lit(1.0)), 9))


def distinct_counts(frame: DataFrame, group: str, columns: Mapping[str, str]) -> DataFrame:
    """Distinct non-null values of columns per group; ``columns`` maps new column to counted column.

    Each column has its own distinct rows, dealt by group and value, and only their numbers
    come together: a task holds its share of one column's values however few the groups are.
    """
    result = None
    for name, column in columns.items():
        pairs = frame.select(group, column).distinct()
        counts = pairs.groupBy(group).agg(F.count(column).alias(name))
        result = counts if result is None else join_keys(result, counts, [group], "left")
    return result


def _spread(sizes: DataFrame, prefix: str) -> DataFrame:
    """Min, max, mean and median of group sizes, from the histogram of sizes.

    Sizes that occur d times over need d*(d+1)/2 rows, so the histogram the
    percentile buffers stays near the square root of the table.
    """
    histogram = sizes.groupBy("n").agg(F.count("*").alias("groups"))
    return histogram.agg(
        F.min("n").alias(f"{prefix}_min"),
        F.max("n").alias(f"{prefix}_max"),
        F.round(F.sum(F.col("n") * F.col("groups")) / F.sum("groups"), 6).alias(f"{prefix}_mean"),
        F.round(F.percentile("n", F.lit(0.5), F.col("groups")), 6).alias(f"{prefix}_median"),
    )


def dataset_summary(
    frame: DataFrame, evaluated: DataFrame | None = None, user: str = "user_id", item: str = "item_id"
) -> DataFrame:
    """One row: interactions, users, items, sparsity by rows and the spread of rows per user and item.

    The frame is stored, and users and items are counted where their sizes are,
    so that no task holds the distinct values of two columns.
    """
    frame = materialise(frame, "rows")
    sizes = {"users": group_sizes(frame, user), "items": group_sizes(frame, item)}
    per_user, per_item = _spread(sizes["users"], "per_user"), _spread(sizes["items"], "per_item")
    counts = {n: s.agg(F.count(k)).scalar() for (n, s), k in zip(sizes.items(), (user, item))}
    empty = F.lit(1.0) - F.col("events") / F.nullif(F.col("users") * F.col("items"), F.lit(0))
    base = frame.agg(F.count("*").alias("events")).withColumns(counts).withColumn("sparsity", F.round(F.coalesce(empty, F.lit(1.0)), 9))
    columns = {name: part.select(name).scalar() for part in (per_user, per_item) for name in part.columns}
    if evaluated is not None:
        columns["evaluated_users"] = evaluated.agg(F.count_distinct(user)).scalar()
    return base.withColumns(columns)


def describe(frame: DataFrame, value: str, fractions: Sequence[float] = (0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """Count, mean, sample deviation, minimum, percentiles and maximum of a column."""
    at = percentiles(frame, value, fractions)
    x = F.col(value).cast("double")
    marks = [F.lit(at[q]).cast("double") for q in fractions]
    return frame.agg(
        F.count(value).alias("n"),
        F.round(F.avg(x), 6).alias("mean"),
        F.round(F.stddev_samp(x), 6).alias("std"),
        F.round(F.min(x), 6).alias("min"),
        *(F.round(m, 6).alias(f"p{round(q * 100)}") for q, m in zip(fractions, marks)),
        F.round(F.max(x), 6).alias("max"),
    )


def quantile_dates(frame: DataFrame, fractions: Sequence[float] = (0.70, 0.85), time: str = "timestamp") -> DataFrame:
    """The calendar dates at the given quantiles of an epoch-ms column."""
    at = percentiles(frame, time, fractions)
    rows = [(q, None if at[q] is None else int(at[q])) for q in fractions]
    cut = frame.sparkSession.createDataFrame(rows, "fraction double, cut_ms long")
    return cut.withColumn("cut_date", F.date_format(F.timestamp_millis("cut_ms"), "yyyy-MM-dd"))


def field_profile(frame: DataFrame, table_name: str, examples: int = 5, digits: int = 2) -> DataFrame:
    """Per column: type, rows, nulls, null share, distinct values and the first few values in order.

    The frame is read once and turned into (field, value, n) counts; examples
    are the smallest values, kept as a bounded list while aggregating.
    """
    types = dict(frame.dtypes)
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in frame.columns))
    values = frame.select(F.inline(fields)).groupBy("field", "value").agg(F.count("*").alias("n"))
    per_field = values.groupBy("field").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
    )
    dtype = reduce(lambda rest, c: F.when(F.col("field") == c, types[c]).otherwise(rest), types, F.lit(None).cast("string"))
    return (
        per_field.join(example_values(values, "field", "value", examples), "field", "left")
        .select(
            F.lit(table_name).alias("table_name"),
            "field",
            dtype.alias("dtype"),
            "rows",
            "nulls",
            percent(F.col("nulls"), F.col("rows"), digits).alias("null_pct"),
            "distinct_values",
            F.coalesce("examples", F.lit("")).alias("examples"),
        )
    )


def example_values(frame: DataFrame, key: str, value: str, n: int = 5) -> DataFrame:
    """The ``n`` smallest distinct values per key joined by ``" | "``; never gathers more than ``n`` per key."""
    distinct = frame.select(key, value).filter(F.col(value).isNotNull()).distinct()
    window = Window.partitionBy(key).orderBy(value)
    few = distinct.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n)
    return few.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(value)), " | ").alias("examples"))


def table_summary(tables: Mapping[str, DataFrame], time: str = "timestamp") -> DataFrame:
    """Rows, columns and first and last time of each table."""
    parts = []
    for name, frame in tables.items():
        bounds = (F.min(time), F.max(time)) if time in frame.columns else (F.lit(None), F.lit(None))
        parts.append(
            frame.agg(
                F.lit(name).alias("table_name"),
                F.count("*").alias("rows"),
                F.lit(len(frame.columns)).alias("columns"),
                bounds[0].cast("long").alias("first_ms"),
                bounds[1].cast("long").alias("last_ms"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def interaction_weights(
    frame: DataFrame, user: str = "visitorid", item: str = "itemid", upper: float | None = 50.0,
    weights: Mapping[str, float] = EVENT_WEIGHTS,
) -> DataFrame:
    """Summed event weights per user and item, clipped from above."""
    total = F.sum(event_weight("event", weights, unknown=0.0).cast("double"))
    return frame.groupBy(user, item).agg((total if upper is None else clip(total, upper)).alias("weight"))


def period_bounds(frame: DataFrame, events: Sequence[str] = FUNNEL, digits: int = 2) -> DataFrame:
    """First and last time and the share of every event type, one row."""
    return frame.agg(
        F.count("*").alias("events"),
        F.min("timestamp").alias("first_ms"),
        F.max("timestamp").alias("last_ms"),
        *(percent(F.count_if(F.col("event") == e), F.count("*"), digits).alias(f"{e}_pct") for e in events),
    )


def weight_check(frame: DataFrame, weights: Mapping[str, float] = EVENT_WEIGHTS, digits: int = 2) -> DataFrame:
    """Rows, mean weight, share of rows and share of targets per event type."""
    total = frame.agg(F.count("*")).scalar()
    weighted = frame.withColumn("_w", event_weight("event", weights, unknown=0.0).cast("double"))
    return weighted.groupBy("event").agg(F.count("*").alias("n"), F.round(F.avg("_w"), 6).alias("mean_weight")).select(
        "event",
        "n",
        "mean_weight",
        percent(F.col("n"), total, digits).alias("pct"),
        is_event("event", "addtocart", "transaction").alias("target_cart_or_buy"),
        is_event("event", "transaction").alias("target_buy"),
    )


def single_visit_share(frame: DataFrame, digits: int = 2) -> DataFrame:
    """Share of visitors with exactly one event."""
    sizes = group_sizes(frame, "visitorid")
    return sizes.agg(
        F.count("*").alias("visitors"),
        F.count_if(F.col("n") == 1).alias("single"),
        percent(F.count_if(F.col("n") == 1), F.count("*"), digits).alias("single_pct"),
    )


def visitor_profiles(frame: DataFrame, events: Sequence[str] = FUNNEL) -> DataFrame:
    """Per visitor: rows per event type, distinct items and the behaviour profile.

    Rows shrink to (visitor, item) counts first; the visitor level only adds those up.
    """
    pairs = frame.groupBy("visitorid", "itemid").agg(
        F.count("*").alias("_n"), *(F.count_if(F.col("event") == e).alias(e) for e in events)
    )
    visitors = pairs.groupBy("visitorid").agg(*(F.sum(e).alias(e) for e in events), F.count("*").alias("unique_items"))
    total = reduce(Column.__add__, (F.col(e) for e in events))
    profile = behaviour_profile(total, F.col("addtocart"), F.col("transaction"))
    return visitors.withColumn("total_events", total).withColumn("profile", profile)


def profile_summary(frame: DataFrame, digits: int = 2) -> DataFrame:
    """Visitors and mean activity per behaviour profile."""
    averages = {
        "avg_events": "total_events",
        "avg_unique_items": "unique_items",
        "avg_views": "view",
        "avg_carts": "addtocart",
        "avg_transactions": "transaction",
    }
    return visitor_profiles(frame).groupBy("profile").agg(
        F.count("*").alias("visitors"), *(F.round(F.avg(c), digits).alias(n) for n, c in averages.items())
    )


def seasonality(frame: DataFrame, event: str = "transaction") -> DataFrame:
    """Events of one type by hour, weekday (Monday first) and month; empty weekdays and months count zero.

    One scan: each row feeds its hour, weekday and month bucket.
    """
    time = F.timestamp_millis("timestamp")
    buckets = F.array(
        F.struct(F.lit("hour").alias("part"), F.hour(time).alias("position"), F.lpad(F.hour(time).cast("string"), 2, "0").alias("label")),
        F.struct(F.lit("weekday").alias("part"), F.weekday(time).alias("position"), F.date_format(time, "EEEE").alias("label")),
        F.struct(
            F.lit("month").alias("part"),
            (F.year(time) * 12 + F.month(time) - 1).alias("position"),
            F.date_format(time, "yyyy-MM").alias("label"),
        ),
    )
    counts = (
        frame.filter(F.col("event") == event)
        .select(F.inline(buckets))
        .groupBy("part", "position", "label")
        .agg(F.count("*").alias("n"))
    )
    weekdays = fill_categories(counts.filter("part = 'weekday'").drop("position"), "label", WEEKDAYS, ["n"])
    months = counts.filter("part = 'month'")
    span = months.agg(F.sequence(F.min("position"), F.max("position")).alias("all")).select(F.explode("all").alias("position"))
    label = F.concat_ws("-", F.floor(F.col("position") / 12).cast("string"), F.lpad((F.col("position") % 12 + 1).cast("string"), 2, "0"))
    every_month = span.join(months.select("position", "n"), "position", "left").select("position", label.alias("label"), F.coalesce("n", F.lit(0)).alias("n"))
    parts = (
        counts.filter("part = 'hour'").select("part", "position", "label", "n"),
        weekdays.select(F.lit("weekday").alias("part"), "position", "label", "n"),
        every_month.select(F.lit("month").alias("part"), "position", "label", "n"),
    )
    return reduce(DataFrame.unionByName, parts)


def monthly_event_mix(frame: DataFrame, events: Sequence[str] = FUNNEL) -> DataFrame:
    """Pivot: rows per month and event type."""
    month = F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM").alias("month")
    return frame.groupBy(month).pivot("event", list(events)).agg(F.count("timestamp")).na.fill(0)


def row_rates(frame: DataFrame, cells: Sequence[str], digits: int = 2) -> DataFrame:
    """Turn the cells of every row into percent of the row total, 0 for empty rows."""
    total = reduce(Column.__add__, (F.col(c) for c in cells))
    return frame.withColumns({f"{c}_pct": percent(F.col(c), total, digits) for c in cells})


def tree_summary(tree: DataFrame) -> DataFrame:
    """Categories, distinct parents and roots of the category tree."""
    return tree.agg(
        F.count("*").alias("categories"),
        F.count_distinct("parentid").alias("parents"),
        F.count_if(F.col("parentid").isNull()).alias("roots"),
    )


def user_history(frame: DataFrame, min_rows: int = 0) -> DataFrame:
    """Rows and distinct items per user and event type, for users with at least ``min_rows`` rows."""
    per_item = frame.groupBy("visitorid", "event", "itemid").agg(F.count("*").alias("n"))
    history = per_item.groupBy("visitorid", "event").agg(F.sum("n").alias("events"), F.count("*").alias("items"))
    if min_rows > 0:
        active = group_sizes(frame, "visitorid").filter(F.col("n") >= min_rows)
        history = history.join(active, "visitorid", "left_semi")
    return history


def membership_rate(frame: DataFrame, key: str, known: DataFrame, known_key: str, digits: int = 2) -> Column:
    """Scalar: percent of rows whose key occurs in another table; rows are first counted per key."""
    per_key = frame.groupBy(key).agg(F.count("*").alias("n"))
    marked = per_key.join(
        known.select(F.col(known_key).alias("_known")).distinct(), F.col(key) == F.col("_known"), "left"
    )
    hit = F.coalesce(F.sum(F.when(F.col("_known").isNotNull(), F.col("n"))), F.lit(0))
    return marked.agg(percent(hit, F.sum("n"), digits)).scalar()


def metric_rows(frame: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """One row per named scalar, as (metric, value); ``frame`` only lends its session."""
    spark = frame.sparkSession
    rows = [F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in measures.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))
