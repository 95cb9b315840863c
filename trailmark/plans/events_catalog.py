"""Registered queries: cleaning, profiling, sessions and flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions.columns import date_parts, draw, event_weight, minutes_between
from trailmark.operators import cleaning, profiling, sessions
from trailmark.operators.ordering import Lanes, percentiles
from trailmark.plans import sql as q
from trailmark.plans.registry import query
from trailmark.sources.driver_tables import category_tree, clicks, property_changes, purchases, raw_events

DIGITS = 6
VISITOR_WINDOW = "(PARTITION BY visitorid ORDER BY timestamp, itemid, event, event_id)"


# ---------------------------------------------------------------- cleaning


@query(
    "normalize_events",
    f"""WITH {q.EV} SELECT timestamp, CAST(visitorid AS VARCHAR) AS visitorid, event, CAST(itemid AS VARCHAR) AS itemid,
    event_id, CAST({q.WEIGHT} AS FLOAT) AS event_weight FROM ev""",
)
def _(spark, folder):
    return cleaning.normalize_events(raw_events(spark, folder)).select(
        "timestamp", "visitorid", "event", "itemid", "event_id", "event_weight"
    )


@query(
    "normalize_orders",
    f"""WITH {q.OL} SELECT timestamp, CAST(visitorid AS VARCHAR) AS visitorid, CAST(itemid AS VARCHAR) AS itemid,
    CAST({q.WEIGHT} AS FLOAT) AS event_weight, count(*) AS n FROM ol GROUP BY ALL""",
)
def _(spark, folder):
    rows = cleaning.normalize_events(purchases(spark, folder))
    return rows.groupBy("timestamp", "visitorid", "itemid", "event_weight").agg(F.count("*").alias("n"))


@query(
    "event_date_parts",
    f"""WITH {q.EV} SELECT event_id, strftime(make_timestamp(timestamp * 1000), '%Y-%m') AS event_month,
    CAST(isodow(make_timestamp(timestamp * 1000)) - 1 AS INTEGER) AS event_dayofweek,
    CAST(hour(make_timestamp(timestamp * 1000)) AS INTEGER) AS event_hour FROM ev""",
)
def _(spark, folder):
    timed = clicks(spark, folder).withColumn("event_time", F.timestamp_millis("timestamp"))
    return timed.select("event_id", *(c.alias(n) for n, c in date_parts("event_time").items()))


@query(
    "sample_rows",
    f"""WITH {q.EV} SELECT timestamp, visitorid, event, itemid, event_id FROM ev
    ORDER BY {q.draw(42, 'event_id')}, event_id LIMIT 2000""",
)
def _(spark, folder):
    rows = clicks(spark, folder).drop("transactionid")
    return cleaning.sample_rows(rows, 2000, 42, ["event_id"]).select("timestamp", "visitorid", "event", "itemid", "event_id")


@query(
    "sample_visitors",
    f"""WITH {q.EV}, chosen AS (
      SELECT visitorid FROM (SELECT DISTINCT visitorid FROM ev) ORDER BY {q.draw(42, 'visitorid')}, visitorid LIMIT 50)
    SELECT event_id, visitorid, event, itemid FROM ev WHERE visitorid IN (SELECT visitorid FROM chosen)""",
)
def _(spark, folder):
    return cleaning.sample_entities(clicks(spark, folder), "visitorid", 50, 42).select("event_id", "visitorid", "event", "itemid")


@query(
    "first_events_from",
    f"""WITH {q.EV}, {q.CHANGES} SELECT event_id, timestamp, visitorid, itemid FROM ev
    WHERE timestamp >= (SELECT min(timestamp) FROM changes) ORDER BY timestamp, visitorid, itemid, event_id LIMIT 1000""",
)
def _(spark, folder):
    start = property_changes(spark, folder).agg(F.min("timestamp")).first()[0]
    rows = cleaning.first_from(clicks(spark, folder), start, 1000, ["timestamp", "visitorid", "itemid", "event_id"])
    return rows.select("event_id", "timestamp", "visitorid", "itemid")


def _catalog_sql(source: str, max_items: int, min_rows: int, rounds: int, columns: str) -> str:
    """The filter rounds written out one after the other."""
    parts, last = [], source
    for r in range(rounds):
        parts.append(
            f"i{r} AS (SELECT itemid FROM {last} GROUP BY 1 ORDER BY count(*) DESC, CAST(itemid AS VARCHAR) LIMIT {max_items}),\n"
            f"a{r} AS (SELECT * FROM {last} WHERE itemid IN (SELECT itemid FROM i{r})),\n"
            f"u{r} AS (SELECT visitorid FROM a{r} GROUP BY 1 HAVING count(*) >= {min_rows}),\n"
            f"f{r} AS (SELECT * FROM a{r} WHERE visitorid IN (SELECT visitorid FROM u{r}))"
        )
        last = f"f{r}"
    return ",\n".join(parts) + f"\nSELECT {columns} FROM {last}"


@query(
    "catalog_filter",
    f"WITH {q.EV},\n" + _catalog_sql("ev", 60, 10, 8, "event_id, CAST(visitorid AS VARCHAR) AS visitorid, CAST(itemid AS VARCHAR) AS itemid"),
)
def _(spark, folder):
    rows = cleaning.normalize_events(clicks(spark, folder))
    return cleaning.catalog_filter(rows, 60, 10).select("event_id", "visitorid", "itemid")


@query(
    "catalog_filter_orders",
    f"WITH {q.OL},\n" + _catalog_sql("ol", 400, 8, 12, "visitorid, itemid, count(*) AS n") + " GROUP BY 1, 2",
)
def _(spark, folder):
    rows = purchases(spark, folder).withColumn("itemid", F.col("itemid").cast("string"))
    kept = cleaning.catalog_filter(rows, 400, 8)
    return kept.groupBy("visitorid", F.col("itemid").cast("bigint").alias("itemid")).agg(F.count("*").alias("n"))


@query("resolve_columns", f"WITH {q.EV} SELECT CAST(visitorid AS VARCHAR) AS user_id, CAST(itemid AS VARCHAR) AS item_id, timestamp FROM ev")
def _(spark, folder):
    return cleaning.resolve_columns(clicks(spark, folder))


@query("dedupe_first", f"WITH {q.EV},\n{q.PAIRS} SELECT * FROM pairs")
def _(spark, folder):
    return cleaning.load_pairs(clicks(spark, folder))


@query("dedupe_first_orders", f"WITH {q.OL},\n{q.OPAIRS} SELECT * FROM pairs")
def _(spark, folder):
    return cleaning.load_pairs(purchases(spark, folder))


@query(
    "dedupe_first_with_columns",
    f"""WITH {q.EV} SELECT visitorid, itemid, event, timestamp, event_id FROM ev
    QUALIFY row_number() OVER (PARTITION BY visitorid, itemid ORDER BY timestamp, event_id) = 1""",
)
def _(spark, folder):
    rows = clicks(spark, folder).select("visitorid", "itemid", "event", "timestamp", "event_id")
    return cleaning.dedupe_first(rows, ["visitorid", "itemid"], "timestamp", ["event_id"])


@query("distinct_pairs", f"WITH {q.OL} SELECT DISTINCT visitorid, itemid FROM ol")
def _(spark, folder):
    return purchases(spark, folder).select("visitorid", "itemid").distinct()


@query("duplicate_count", f"WITH {q.OL} SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM ol GROUP BY timestamp, visitorid, event, itemid)")
def _(spark, folder):
    return cleaning.duplicate_count(purchases(spark, folder))


@query(
    "number_events",
    f"""WITH {q.EV} SELECT event_id AS source_id,
    row_number() OVER (ORDER BY timestamp, visitorid, itemid, event, event_id) AS event_id FROM ev""",
)
def _(spark, folder):
    rows = clicks(spark, folder).withColumnRenamed("event_id", "source_id")
    order = ["timestamp", "visitorid", "itemid", "event", "source_id"]
    return cleaning.number_events(rows, order).select("source_id", "event_id")


# ---------------------------------------------------------------- profiling


@query(
    "event_distribution",
    f"WITH {q.RAW} SELECT event, count(*) AS n, round(100e0 * count(*) / (SELECT count(*) FROM raw), 6) AS pct FROM raw GROUP BY 1",
)
def _(spark, folder):
    return profiling.value_counts(raw_events(spark, folder), "event", DIGITS)


@query("null_counts", f"WITH {q.RAW} SELECT event, transactionid IS NULL AS is_null, count(*) AS n FROM raw GROUP BY 1, 2")
def _(spark, folder):
    return profiling.null_counts_by(raw_events(spark, folder), "event", "transactionid")


def _field_sql(table: str, fields: dict[str, str]) -> str:
    parts = [
        f"""SELECT 'events' AS table_name, '{f}' AS field, '{t}' AS dtype, count(*) AS rows, count(*) - count({f}) AS nulls,
        round(100e0 * (count(*) - count({f})) / count(*), 6) AS null_pct, count(DISTINCT {f}) AS distinct_values,
        (SELECT coalesce(string_agg(v, ' | ' ORDER BY v), '') FROM
          (SELECT DISTINCT CAST({f} AS VARCHAR) AS v FROM {table} WHERE {f} IS NOT NULL ORDER BY v LIMIT 5)) AS examples
        FROM {table}"""
        for f, t in fields.items()
    ]
    return " UNION ALL ".join(parts)


@query(
    "field_profile",
    f"WITH {q.RAW} "
    + _field_sql(
        "raw",
        {"timestamp": "bigint", "visitorid": "bigint", "event": "string", "itemid": "bigint", "transactionid": "bigint", "event_id": "bigint"},
    ),
)
def _(spark, folder):
    return profiling.field_profile(raw_events(spark, folder), "events", 5, DIGITS)


@query(
    "table_summary",
    f"""WITH {q.EV}, {q.CHANGES}, {q.TREE}
    SELECT 'events' AS table_name, count(*) AS rows, 6 AS columns, min(timestamp) AS first_ms, max(timestamp) AS last_ms FROM ev
    UNION ALL SELECT 'item_properties', count(*), 5, min(timestamp), max(timestamp) FROM changes
    UNION ALL SELECT 'category_tree', count(*), 2, NULL, NULL FROM tree""", doubles=("first_ms", "last_ms"))
def _(spark, folder):
    tables = {
        "events": clicks(spark, folder),
        "item_properties": property_changes(spark, folder),
        "category_tree": category_tree(spark, folder),
    }
    return profiling.table_summary(tables)


def _sparsity_sql(source: str) -> str:
    return f"""SELECT count(*) AS events, count(DISTINCT visitorid) AS users, count(DISTINCT itemid) AS items,
    count(DISTINCT (visitorid, itemid)) AS pairs,
    round(1e0 - count(DISTINCT (visitorid, itemid)) / CAST(count(DISTINCT visitorid) * count(DISTINCT itemid) AS DOUBLE), 9) AS sparsity
    FROM {source}"""


@query("sparsity", f"WITH {q.EV} {_sparsity_sql('ev')}")
def _(spark, folder):
    return profiling.sparsity(clicks(spark, folder))


@query("sparsity_orders", f"WITH {q.OL} {_sparsity_sql('ol')}")
def _(spark, folder):
    return profiling.sparsity(purchases(spark, folder))


@query("group_sizes", f"WITH {q.EV} SELECT visitorid, count(*) AS n FROM ev GROUP BY 1")
def _(spark, folder):
    return profiling.group_sizes(clicks(spark, folder), "visitorid")


_SUMMARY_SQL = """,
pu AS (SELECT user_id, count(*) AS n FROM pairs GROUP BY 1), pi AS (SELECT item_id, count(*) AS n FROM pairs GROUP BY 1)
SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items,
  round(1e0 - count(*) / CAST(count(DISTINCT user_id) * count(DISTINCT item_id) AS DOUBLE), 9) AS sparsity,
  (SELECT min(n) FROM pu) AS per_user_min, (SELECT max(n) FROM pu) AS per_user_max,
  (SELECT round(avg(n), 6) FROM pu) AS per_user_mean, (SELECT round(quantile_cont(n, 0.5), 6) FROM pu) AS per_user_median,
  (SELECT min(n) FROM pi) AS per_item_min, (SELECT max(n) FROM pi) AS per_item_max,
  (SELECT round(avg(n), 6) FROM pi) AS per_item_mean, (SELECT round(quantile_cont(n, 0.5), 6) FROM pi) AS per_item_median
FROM pairs"""


@query("dataset_summary", f"WITH {q.EV},\n{q.PAIRS}{_SUMMARY_SQL}")
def _(spark, folder):
    return profiling.dataset_summary(cleaning.load_pairs(clicks(spark, folder)))


@query("dataset_summary_orders", f"WITH {q.OL},\n{q.OPAIRS}{_SUMMARY_SQL}")
def _(spark, folder):
    return profiling.dataset_summary(cleaning.load_pairs(purchases(spark, folder)))


def _describe_sql(value: str) -> str:
    marks = ", ".join(f"round(quantile_cont({value}, {p / 100}), 6) AS p{p}" for p in (50, 75, 90, 99))
    return (
        f"count({value}) AS n, round(avg({value}), 6) AS mean, round(stddev_samp({value}), 6) AS std, "
        f"round(CAST(min({value}) AS DOUBLE), 6) AS min, {marks}, round(CAST(max({value}) AS DOUBLE), 6) AS max"
    )


@query("interaction_percentiles", f"WITH {q.OL}, sizes AS (SELECT visitorid, CAST(count(*) AS DOUBLE) AS n FROM ol GROUP BY 1) SELECT {_describe_sql('n')} FROM sizes")
def _(spark, folder):
    return profiling.describe(profiling.group_sizes(purchases(spark, folder), "visitorid"), "n")


@query(
    "gap_profile",
    f"WITH {q.EV},\n{q.GAPS} SELECT event, {_describe_sql('minutes')} FROM gaps GROUP BY 1",
)
def _(spark, folder):
    return sessions.gap_profile(clicks(spark, folder))


@query(
    "quantile_dates",
    f"WITH {q.EV} "
    + " UNION ALL ".join(
        f"""SELECT {f}e0 AS fraction, CAST(floor(quantile_cont(timestamp, {f})) AS BIGINT) AS cut_ms,
        strftime(make_timestamp(CAST(floor(quantile_cont(timestamp, {f})) AS BIGINT) * 1000), '%Y-%m-%d') AS cut_date FROM ev"""
        for f in (0.7, 0.85)
    ),
)
def _(spark, folder):
    return profiling.quantile_dates(clicks(spark, folder))


@query(
    "interaction_weights",
    f"WITH {q.EV} SELECT visitorid, itemid, least(sum({q.WEIGHT}), 50e0) AS weight FROM ev GROUP BY 1, 2",
)
def _(spark, folder):
    return profiling.interaction_weights(clicks(spark, folder))


@query(
    "period_bounds",
    f"""WITH {q.EV} SELECT count(*) AS events, min(timestamp) AS first_ms, max(timestamp) AS last_ms,
    """ + ", ".join(f"round(100e0 * count(*) FILTER (event = '{e}') / count(*), 6) AS {e}_pct" for e in ("view", "addtocart", "transaction")) + " FROM ev",
)
def _(spark, folder):
    return profiling.period_bounds(clicks(spark, folder), digits=DIGITS)


@query(
    "weight_check",
    f"""WITH {q.RAW} SELECT event, count(*) AS n, round(avg({q.WEIGHT}), 6) AS mean_weight,
    round(100e0 * count(*) / (SELECT count(*) FROM raw), 6) AS pct,
    CAST(event IN ('addtocart', 'transaction') AS INTEGER) AS target_cart_or_buy,
    CAST(event = 'transaction' AS INTEGER) AS target_buy FROM raw GROUP BY 1""",
)
def _(spark, folder):
    return profiling.weight_check(raw_events(spark, folder), digits=DIGITS)


@query(
    "single_visit_share",
    f"""WITH {q.EV}, s AS (SELECT visitorid, count(*) AS n FROM ev GROUP BY 1)
    SELECT count(*) AS visitors, count(*) FILTER (n = 1) AS single, round(100e0 * count(*) FILTER (n = 1) / count(*), 6) AS single_pct FROM s""",
)
def _(spark, folder):
    return profiling.single_visit_share(clicks(spark, folder), DIGITS)


_PROFILES = """profiles AS (
  SELECT visitorid, count(*) FILTER (event = 'view') AS view, count(*) FILTER (event = 'addtocart') AS addtocart,
    count(*) FILTER (event = 'transaction') AS transaction, count(DISTINCT itemid) AS unique_items, count(*) AS total_events,
    CASE WHEN count(*) FILTER (event = 'transaction') > 0 THEN 'buyer' WHEN count(*) FILTER (event = 'addtocart') > 0 THEN 'cart_intent'
      WHEN count(*) >= 5 THEN 'recurring_browser' ELSE 'cold_or_single_view' END AS profile
  FROM {source} GROUP BY 1)"""


@query(
    "visitor_profiles",
    f"WITH {q.OL}, {_PROFILES.format(source='ol')} SELECT * FROM profiles",
)
def _(spark, folder):
    return profiling.visitor_profiles(purchases(spark, folder))


@query(
    "profile_summary",
    f"""WITH {q.OL}, {_PROFILES.format(source='ol')} SELECT profile, count(*) AS visitors, round(avg(total_events), 6) AS avg_events,
    round(avg(unique_items), 6) AS avg_unique_items, round(avg(view), 6) AS avg_views, round(avg(addtocart), 6) AS avg_carts,
    round(avg(transaction), 6) AS avg_transactions FROM profiles GROUP BY 1""",
)
def _(spark, folder):
    return profiling.profile_summary(purchases(spark, folder), DIGITS)


@query(
    "seasonality",
    f"""WITH {q.EV}, t AS (SELECT make_timestamp(timestamp * 1000) AS moment FROM ev WHERE event = 'transaction'),
    days(position, label) AS (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')),
    months AS (SELECT unnest(generate_series((SELECT min(year(moment) * 12 + month(moment) - 1) FROM t), (SELECT max(year(moment) * 12 + month(moment) - 1) FROM t))) AS position)
    SELECT 'hour' AS part, hour(moment) AS position, lpad(CAST(hour(moment) AS VARCHAR), 2, '0') AS label, count(*) AS n FROM t GROUP BY ALL
    UNION ALL SELECT 'weekday', position, label, count(moment) FROM days LEFT JOIN t ON dayname(moment) = label GROUP BY ALL
    UNION ALL SELECT 'month', position, concat(position // 12, '-', lpad(CAST(position % 12 + 1 AS VARCHAR), 2, '0')), count(moment)
      FROM months LEFT JOIN t ON year(moment) * 12 + month(moment) - 1 = position GROUP BY ALL""",
)
def _(spark, folder):
    return profiling.seasonality(clicks(spark, folder)).withColumn("position", F.col("position").cast("bigint"))


@query(
    "monthly_event_mix",
    f"""WITH {q.OL} SELECT strftime(make_timestamp(timestamp * 1000), '%Y-%m') AS month,
    count(*) FILTER (event = 'view') AS view, count(*) FILTER (event = 'addtocart') AS addtocart,
    count(*) FILTER (event = 'transaction') AS transaction FROM ol GROUP BY 1""",
)
def _(spark, folder):
    return profiling.monthly_event_mix(purchases(spark, folder))


@query(
    "visitor_event_rates",
    f"""WITH {q.EV}, c AS (SELECT visitorid, count(*) FILTER (event = 'view') AS view, count(*) FILTER (event = 'addtocart') AS addtocart,
      count(*) FILTER (event = 'transaction') AS transaction, count(*) AS n FROM ev GROUP BY 1)
    SELECT visitorid, view, addtocart, transaction, round(100e0 * view / n, 6) AS view_pct,
      round(100e0 * addtocart / n, 6) AS addtocart_pct, round(100e0 * transaction / n, 6) AS transaction_pct FROM c""",
)
def _(spark, folder):
    from trailmark.functions.columns import FUNNEL

    table = clicks(spark, folder).groupBy("visitorid").pivot("event", list(FUNNEL)).agg(F.count("itemid")).na.fill(0)
    return profiling.row_rates(table, FUNNEL, DIGITS)


@query("top_items", f"WITH {q.OL} SELECT itemid, count(*) AS transactions FROM ol WHERE event = 'transaction' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(spark, folder):
    rows = purchases(spark, folder).filter("event = 'transaction'")
    return profiling.top_counts(rows, "itemid", 15, "transactions")


@query("top_buyers", f"WITH {q.OL} SELECT visitorid, count(*) AS transactions FROM ol WHERE event = 'transaction' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(spark, folder):
    rows = purchases(spark, folder).filter("event = 'transaction'")
    return profiling.top_counts(rows, "visitorid", 15, "transactions")


@query("tree_summary", f"WITH {q.TREE} SELECT count(*) AS categories, count(DISTINCT parentid) AS parents, count(*) FILTER (parentid IS NULL) AS roots FROM tree")
def _(spark, folder):
    return profiling.tree_summary(category_tree(spark, folder))


@query(
    "user_history",
    f"""WITH {q.EV} SELECT visitorid, event, count(*) AS events, count(DISTINCT itemid) AS items FROM ev
    WHERE visitorid IN (SELECT visitorid FROM ev GROUP BY 1 HAVING count(*) >= 5) GROUP BY 1, 2""",
)
def _(spark, folder):
    return profiling.user_history(clicks(spark, folder), 5)


@query(
    "event_shares_by_draw",
    f"""WITH {q.EV} SELECT event, CAST(({q.draw(7, 'event_id')}) % 10 AS BIGINT) AS bucket, count(*) AS n,
    round(sum({q.WEIGHT}), 6) AS weight FROM ev GROUP BY 1, 2""",
)
def _(spark, folder):
    rows = clicks(spark, folder).withColumn("w", event_weight("event").cast("double"))
    bucket = F.pmod(draw(7, F.col("event_id").cast("string")), F.lit(10)).alias("bucket")
    return rows.groupBy("event", bucket).agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("weight"))


# ---------------------------------------------------------------- sessions and flow


def _session_sql(gap: float) -> str:
    return f"""flagged AS (SELECT *, CASE WHEN previous_timestamp IS NULL OR minutes >= {gap}
      OR (previous_event = 'transaction' AND event <> 'transaction') THEN 1 ELSE 0 END AS starts FROM gaps),
    sess AS (SELECT event_id, visitorid, timestamp, event, CAST(sum(starts) OVER
      (PARTITION BY visitorid ORDER BY timestamp, itemid, event, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_index FROM flagged)"""


for _name, _gap in (("sessionize", 30), ("sessionize_6h", 360), ("sessionize_24h", 1440)):

    @query(
        _name,
        f"""WITH {q.EV},\n{q.GAPS},\n{_session_sql(_gap)}
        SELECT event_id, visitorid, session_index, concat(visitorid, '_', session_index) AS session_id FROM sess""",
    )
    def _(spark, folder, gap=_gap):
        return sessions.sessionize(clicks(spark, folder), gap).select("event_id", "visitorid", "session_index", "session_id")


@query(
    "session_table",
    f"""WITH {q.EV},\n{q.GAPS},\n{_session_sql(1440)}
    SELECT visitorid, session_index, concat(visitorid, '_', session_index) AS session_id, count(*) AS n_events,
      round((max(timestamp) - min(timestamp)) / 60000e0, 6) AS duration_min, string_agg(DISTINCT event, ' ' ORDER BY event) AS event_types,
      max(CAST(event = 'transaction' AS INTEGER)) AS has_purchase FROM sess GROUP BY 1, 2""",
)
def _(spark, folder):
    table = sessions.session_table(sessions.sessionize(clicks(spark, folder), 1440))
    return table.withColumn("duration_min", F.round("duration_min", 6))


_STATS_SQL = """,
tab AS (SELECT visitorid, session_index, count(*) AS n_events, (max(timestamp) - min(timestamp)) / 60000e0 AS duration_min FROM sess GROUP BY 1, 2),
vals AS (SELECT 'n_events' AS metric, CAST(n_events AS DOUBLE) AS v FROM tab UNION ALL SELECT 'duration_min', duration_min FROM tab WHERE n_events > 1),
placed AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY v) - 1 AS pos, count(*) OVER (PARTITION BY metric) AS n FROM vals)
SELECT metric, 'median' AS statistic, round(quantile_cont(v, 0.5), 6) AS value FROM vals GROUP BY 1
UNION ALL SELECT metric, 'p90', round(v, 6) FROM placed WHERE pos = floor(0.9e0 * (n - 1) + 0.5e0)
UNION ALL SELECT metric, 'p99', round(v, 6) FROM placed WHERE pos = floor(0.99e0 * (n - 1) + 0.5e0)
UNION ALL SELECT metric, 'max', round(max(v), 6) FROM vals GROUP BY 1"""


@query("session_stats", f"WITH {q.EV},\n{q.GAPS},\n{_session_sql(1440)}{_STATS_SQL}")
def _(spark, folder):
    from trailmark.storage import materialise

    table = sessions.session_table(sessions.sessionize(clicks(spark, folder), 1440))
    return sessions.session_percentiles(materialise(table, "sessions"))


@query(
    "session_rule_compare",
    f"""WITH {q.EV},\n{q.GAPS}, t AS (SELECT
      count(*) FILTER (previous_timestamp IS NULL OR minutes >= 30) AS g,
      count(*) FILTER (previous_timestamp IS NULL OR minutes >= 30 OR (previous_event = 'transaction' AND event <> 'transaction')) AS p FROM gaps)
    SELECT 'gap_only' AS rule, g AS sessions, CAST(0 AS BIGINT) AS extra FROM t UNION ALL SELECT 'gap_or_purchase', p, p - g FROM t""",
)
def _(spark, folder):
    return sessions.session_rule_comparison(clicks(spark, folder))


@query(
    "gap_only_sessions",
    f"""WITH {q.EV},\n{q.GAPS} SELECT event_id, CAST(1 + sum(CASE WHEN minutes >= 1440 THEN 1 ELSE 0 END) OVER
    (PARTITION BY visitorid ORDER BY timestamp, itemid, event, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_index FROM gaps""",
)
def _(spark, folder):
    return sessions.sessionize(clicks(spark, folder), 1440, purchase_ends=False).select("event_id", "session_index")


_BIN = """CASE WHEN minutes <= 5 THEN 0 WHEN minutes <= 10 THEN 1 WHEN minutes <= 30 THEN 2 WHEN minutes <= 60 THEN 3
  WHEN minutes <= 120 THEN 4 WHEN minutes <= 1440 THEN 5 WHEN minutes <= 10080 THEN 6 WHEN minutes <= 43200 THEN 7 ELSE 8 END AS bin"""
_LABEL = """CASE bin WHEN 0 THEN '(-inf, 5]' WHEN 1 THEN '(5, 10]' WHEN 2 THEN '(10, 30]' WHEN 3 THEN '(30, 60]' WHEN 4 THEN '(60, 120]'
  WHEN 5 THEN '(120, 1440]' WHEN 6 THEN '(1440, 10080]' WHEN 7 THEN '(10080, 43200]' ELSE '(43200, inf]' END AS gap_bin"""


@query(
    "gap_distribution",
    f"""WITH {q.EV},\n{q.GAPS}, b AS (SELECT {_BIN}, count(*) AS gaps FROM gaps WHERE minutes IS NOT NULL GROUP BY 1)
    SELECT CAST(bin AS INTEGER) AS bin, {_LABEL}, gaps, round(100e0 * gaps / (SELECT sum(gaps) FROM b), 6) AS pct FROM b""",
)
def _(spark, folder):
    return sessions.gap_distribution(clicks(spark, folder), digits=DIGITS)


@query(
    "session_sensitivity",
    f"""WITH {q.EV},\n{q.GAPS}, g(gap_minutes) AS (VALUES (30), (60), (1440))
    SELECT CAST(gap_minutes AS INTEGER) AS gap_minutes, count(*) FILTER (minutes IS NULL OR minutes >= gap_minutes) AS sessions,
    count(*) AS events FROM gaps CROSS JOIN g GROUP BY 1""",
)
def _(spark, folder):
    return sessions.session_sensitivity(clicks(spark, folder), (30, 60, 1440))


@query(
    "previous_event",
    f"""WITH {q.EV},\n{q.GAPS} SELECT event_id, previous_event, previous_timestamp, round(minutes, 6) AS minutes_since_previous FROM gaps""", doubles=("previous_timestamp",))
def _(spark, folder):
    rows = sessions.with_previous(clicks(spark, folder))
    return rows.select("event_id", "previous_event", "previous_timestamp", F.round("minutes_since_previous", 6).alias("minutes_since_previous"))


@query(
    "next_event",
    f"""WITH {q.EV},\n{q.NEXT} SELECT event_id, next_event, next_itemid, round((next_timestamp - timestamp) / 60000e0, 6) AS minutes_to_next FROM following""", doubles=("next_itemid",))
def _(spark, folder):
    rows = sessions.with_next(clicks(spark, folder))
    return rows.select("event_id", "next_event", "next_itemid", F.round("minutes_to_next", 6).alias("minutes_to_next"))


@query(
    "history_counts",
    f"""WITH {q.EV} SELECT event_id,
      row_number() OVER (PARTITION BY visitorid ORDER BY timestamp, visitorid, itemid, event, event_id) - 1 AS user_events_before,
      row_number() OVER (PARTITION BY itemid ORDER BY timestamp, visitorid, itemid, event, event_id) - 1 AS item_events_before,
      round((timestamp - lag(timestamp) OVER (PARTITION BY itemid ORDER BY timestamp, visitorid, event, event_id)) / 60000e0, 6) AS item_minutes FROM ev""",
)
def _(spark, folder):
    from trailmark.operators.temporal import EVENT_ORDER, with_history

    rows = with_history(clicks(spark, folder), [*EVENT_ORDER, "event_id"])
    lanes = Lanes(rows, ["itemid"], ["timestamp", "visitorid", "event", "event_id"]).neighbour({"_before": "timestamp"}, -1)
    return lanes.result().select(
        "event_id", "user_events_before", "item_events_before", F.round(minutes_between("timestamp", "_before"), 6).alias("item_minutes")
    )


@query(
    "transitions",
    f"""WITH {q.EV},\n{q.NEXT}, names(e, o) AS (VALUES ('view', 0), ('addtocart', 1), ('transaction', 2)),
    c AS (SELECT a.e AS event, b.e AS next_event, count(f.event_id) AS all_items, count(f.event_id) FILTER (f.itemid = f.next_itemid) AS same_item
      FROM names a CROSS JOIN names b LEFT JOIN following f ON f.event = a.e AND f.next_event = b.e GROUP BY 1, 2)
    SELECT event, next_event, all_items, round(coalesce(100e0 * all_items / nullif(sum(all_items) OVER (PARTITION BY event), 0), 0), 6) AS all_items_pct,
      same_item, round(coalesce(100e0 * same_item / nullif(sum(same_item) OVER (PARTITION BY event), 0), 0), 6) AS same_item_pct FROM c""",
)
def _(spark, folder):
    return sessions.transitions(clicks(spark, folder), digits=DIGITS)


@query(
    "visitor_paths",
    f"""WITH {q.EV}, s AS (SELECT visitorid, event, row_number() OVER {VISITOR_WINDOW} AS step FROM ev),
    p AS (SELECT visitorid, string_agg(event, ' > ' ORDER BY step) AS path FROM s WHERE step <= 8 GROUP BY 1)
    SELECT path, count(*) AS visitors FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def _(spark, folder):
    return sessions.top_paths(clicks(spark, folder))


@query(
    "outcome_signature",
    f"""WITH {q.OL}, f AS (SELECT visitorid, max(CAST(event = 'view' AS INTEGER)) AS v, max(CAST(event = 'addtocart' AS INTEGER)) AS a,
      max(CAST(event = 'transaction' AS INTEGER)) AS t FROM ol GROUP BY 1)
    SELECT concat('view=', v, ' addtocart=', a, ' transaction=', t) AS signature, count(*) AS visitors FROM f GROUP BY 1""",
)
def _(spark, folder):
    return sessions.outcome_counts(purchases(spark, folder))


@query(
    "ordered_items",
    f"""WITH {q.EV} SELECT visitorid, itemid, timestamp, event_id, row_number() OVER (PARTITION BY visitorid ORDER BY timestamp, event_id) AS position FROM ev""",
)
def _(spark, folder):
    return sessions.ordered_items(clicks(spark, folder), "visitorid", "itemid", ["timestamp", "event_id"])


@query(
    "gap_percentiles",
    f"""WITH {q.EV},\n{q.GAPS} SELECT 0.5e0 AS fraction, round(quantile_cont(minutes, 0.5), 6) AS minutes FROM gaps
    UNION ALL SELECT 0.9e0, round(quantile_cont(minutes, 0.9), 6) FROM gaps UNION ALL SELECT 0.99e0, round(quantile_cont(minutes, 0.99), 6) FROM gaps""",
)
def _(spark, folder):
    at = percentiles(sessions.with_previous(clicks(spark, folder)), "minutes_since_previous", [0.5, 0.9, 0.99])
    return spark.createDataFrame(list(at.items()), "fraction double, minutes double").withColumn("minutes", F.round("minutes", 6))
