"""Event, property and category sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions.columns import FUNNEL, event_time
from trailmark.operators.cleaning import REQUIRED, keep_events, load_pairs

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("visitorid", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("itemid", T.LongType()),
        T.StructField("transactionid", T.DoubleType()),
    ]
)
PROPERTY_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("itemid", T.LongType()),
        T.StructField("property", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)
TREE_SCHEMA = T.StructType([T.StructField("categoryid", T.LongType()), T.StructField("parentid", T.LongType())])


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def _csv(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Typed scan of CSV files that may order their columns differently."""
    types = {f.name: f for f in schema.fields}
    parts = []
    for path in paths:
        header = _header(spark, path)
        fields = [types.get(c, T.StructField(c, T.StringType())) for c in header]
        known = [c for c in schema.names if c in header]
        parts.append(spark.read.schema(T.StructType(fields)).option("header", True).csv(path).select(*known))
    return reduce(DataFrame.unionByName, parts)


def read_events(spark: SparkSession, path: str, columns: Sequence[str] = REQUIRED) -> DataFrame:
    """The given event columns of a CSV file; a missing column is an error naming it."""
    missing = sorted(set(columns) - set(_header(spark, path)))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return _csv(spark, [path], EVENT_SCHEMA).select(*columns)


def read_positive_events(spark: SparkSession, path: str, events: Sequence[str] = FUNNEL) -> DataFrame:
    """User, item and time of the positive events."""
    read = read_events(spark, path, EVENT_SCHEMA.names)
    return keep_events(read, events).select("visitorid", "itemid", "timestamp")


def read_timed_events(spark: SparkSession, path: str) -> DataFrame:
    """Events with their UTC time."""
    return _csv(spark, [path], EVENT_SCHEMA).withColumn("event_time", event_time())


def read_properties(spark: SparkSession, paths: Sequence[str], rows_per_file: int | None = None) -> DataFrame:
    """The property changelog from its part files, optionally the first rows of each."""
    parts = [_csv(spark, [p], PROPERTY_SCHEMA) for p in paths]
    if rows_per_file is not None:
        parts = [p.limit(rows_per_file) for p in parts]
    return reduce(DataFrame.unionByName, parts).withColumn("property_time", F.timestamp_millis("timestamp"))


def read_category_tree(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, [path], TREE_SCHEMA)


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """A stored interaction or feature table."""
    return spark.read.parquet(path)


def _files(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Names and paths in a folder of any file system Spark can reach, sorted by name."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    return sorted((s.getPath().getName(), s.getPath().toString()) for s in system.listStatus(path))


def missing_inputs(spark: SparkSession, folder: str, names: Sequence[str]) -> list[str]:
    """Expected input files that the folder lacks."""
    present = {name for name, _ in _files(spark, folder)}
    return [n for n in names if n not in present]


def load_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """Interactions of a folder: ``interactions.parquet``, else all parquet files, a CSV named after events, any CSV."""
    files = _files(spark, folder)
    parquet = [p for n, p in files if n.endswith(".parquet")]
    csv = [(n, p) for n, p in files if n.endswith(".csv")]
    chosen = [p for n, p in files if n == "interactions.parquet"] or parquet
    if chosen:
        return load_pairs(spark.read.parquet(*chosen))
    if csv:
        path = next((p for n, p in csv if "event" in n.lower()), csv[0][1])
        typed = {f.name: f for f in EVENT_SCHEMA.fields}
        fields = [typed.get(c, T.StructField(c, T.StringType())) for c in _header(spark, path)]
        return load_pairs(spark.read.schema(T.StructType(fields)).option("header", True).csv(path))
    raise FileNotFoundError(f"no CSV or parquet file in {folder}")


def reference_metric(spark: SparkSession, path: str, column: str = "harmonic_mean_at_10") -> float | None:
    """Best value of a comparison file; None when the file is missing, empty or lacks the column."""
    folder, _, name = path.rpartition("/")
    if missing_inputs(spark, folder or ".", [name]):
        return None
    table = spark.read.option("header", True).csv(path)
    if column not in table.columns:
        return None
    return table.agg(F.max(F.col(column).try_cast("double"))).first()[0]
