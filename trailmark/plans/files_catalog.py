"""Queries on the file sources and sinks: tables are written to the scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.models import simple
from trailmark.operators import encoding
from trailmark.plans import comparison
from trailmark.plans import sql as q
from trailmark.plans.models_catalog import holdout
from trailmark.plans.registry import query
from trailmark.sources import readers, writers
from trailmark.sources.driver_tables import category_tree, clicks, property_changes, raw_events
from trailmark.storage import materialise, scratch_path

EVENT_COLUMNS = readers.EVENT_SCHEMA.names


def _csv(frame: DataFrame, label: str, parts: int = 3) -> str:
    path = scratch_path(frame.sparkSession, label)
    frame.repartition(parts).write.option("header", True).csv(path)
    return path


def _events_file(spark: SparkSession, folder: str) -> str:
    return _csv(raw_events(spark, folder).select(*EVENT_COLUMNS), "events")


@query("csv_events", f"WITH {q.RAW} SELECT timestamp, visitorid, event, itemid FROM raw", doubles=("itemid",))
def _(spark, folder):
    return readers.read_events(spark, _events_file(spark, folder), ["timestamp", "visitorid", "event", "itemid"])


@query("csv_positive_events", f"WITH {q.EV} SELECT visitorid, itemid, timestamp FROM ev", doubles=("itemid",))
def _(spark, folder):
    return readers.read_positive_events(spark, _events_file(spark, folder))


@query("csv_timed_events", f"WITH {q.RAW} SELECT timestamp, visitorid, event, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d %H:%M') AS minute FROM raw")
def _(spark, folder):
    timed = readers.read_timed_events(spark, _events_file(spark, folder))
    return timed.select("timestamp", "visitorid", "event", F.date_format("event_time", "yyyy-MM-dd HH:mm").alias("minute"))


def _property_files(spark: SparkSession, folder: str) -> list[str]:
    """The changelog in two parts whose columns stand in different orders."""
    changes = materialise(property_changes(spark, folder).select("timestamp", "itemid", "property", "value"), "changes")
    first = F.col("property") == "available"
    turned = changes.filter(~first).select("value", "property", "itemid", "timestamp")
    return [_csv(changes.filter(first), "properties-1", 1), _csv(turned, "properties-2", 2)]


@query("csv_properties", f"WITH {q.CHANGES} SELECT timestamp, itemid, property, value FROM changes")
def _(spark, folder):
    return readers.read_properties(spark, _property_files(spark, folder)).drop("property_time")


@query(
    "csv_properties_head",
    f"""WITH {q.CHANGES} SELECT property, least(count(*), 50) AS n FROM changes GROUP BY property""",
)
def _(spark, folder):
    return readers.read_properties(spark, _property_files(spark, folder), rows_per_file=50).groupBy("property").agg(F.count("*").alias("n"))


@query("csv_category_tree", f"WITH {q.TREE} SELECT * FROM tree")
def _(spark, folder):
    return readers.read_category_tree(spark, _csv(category_tree(spark, folder), "tree", 2))


@query("discovered_interactions", f"WITH {q.EV} SELECT DISTINCT CAST(visitorid AS VARCHAR) AS user_id, CAST(itemid AS VARCHAR) AS item_id FROM ev WHERE itemid IS NOT NULL")
def _(spark, folder):
    """A folder of several parquet parts without an interactions file is read whole."""
    path = scratch_path(spark, "folder")
    writers.write_parquet(clicks(spark, folder).select("visitorid", "itemid", "timestamp").repartition(4), path)
    return readers.load_interactions(spark, path).select("user_id", "item_id")


@query("parquet_sink_by_event", f"WITH {q.EV} SELECT event, event_id, timestamp FROM ev")
def _(spark, folder):
    path = scratch_path(spark, "by-event")
    writers.write_parquet(clicks(spark, folder).select("event", "event_id", "timestamp"), path, by="event")
    return readers.read_interactions(spark, path).select("event", "event_id", "timestamp")


@query("json_sink", f"WITH {q.EV} SELECT event, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM ev GROUP BY event")
def _(spark, folder):
    path = scratch_path(spark, "json")
    counted = clicks(spark, folder).groupBy("event").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    writers.write_json(counted, path)
    return spark.read.json(path).select("event", "n", "first", "last")


@query("id_table_sink", f"WITH {q.EV} SELECT count(DISTINCT visitorid) AS users, count(DISTINCT itemid) AS items FROM ev")
def _(spark, folder):
    path = scratch_path(spark, "ids")
    events = clicks(spark, folder)
    writers.write_id_tables(encoding.id_table(events, "visitorid"), encoding.id_table(events, "itemid"), path)
    users, items = writers.entity_counts(spark, path)
    return spark.range(1).select(F.lit(users).cast("long").alias("users"), F.lit(items).cast("long").alias("items"))


@query(
    "comparison_sink",
    f"""WITH {q.HOLDOUT}, {q.popular('train', 20)}, {q.metric_ctes((5, 10, 20))},
    m AS (SELECT avg(precision) AS p, avg(recall) AS r, avg(ndcg) AS n, avg(map) AS a FROM per_user WHERE k = 10)
    SELECT 1 AS models, round(CASE WHEN least(p, r, n, a) > 0 THEN 4e0 / (1 / p + 1 / r + 1 / n + 1 / a) ELSE 0 END, 6) AS best FROM m""",
)
def _(spark, folder):
    """Write a comparison as CSV, and find its best harmonic mean as the reference metric."""
    train, truth, _ = holdout(spark, folder)
    metrics = comparison.compare_models(train, truth, {"popularity": simple.popularity}, (5, 10, 20))
    path = scratch_path(spark, "comparison")
    writers.write_comparison(comparison.comparison_table(metrics, (5, 10, 20)), path)
    best = readers.reference_metric(spark, path)
    return spark.read.option("header", True).csv(path).agg(F.count("*").alias("models"), F.round(F.lit(best), 6).alias("best"))
