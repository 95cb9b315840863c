"""Session settings every operator relies on."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import trailmark
from trailmark.storage import folder_bytes

# functions sent to Python workers carry their code along, so executors need no copy of this package
cloudpickle.register_pickle_by_value(trailmark)

RUNTIME_SETTINGS = {
    # epoch-ms columns are read as UTC instants everywhere
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # hot join keys are split at run time, even when that costs one more exchange
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # bounds what a task and its Python worker hold of long texts at a time
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}

READ_BYTES = "16m"  # of shuffled data that one task reads, unless the session names a size
INPUT_BYTES = 4 << 20  # of stored input for each shuffle partition
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def scale_to(spark: SparkSession, folder: str) -> SparkSession:
    """Let the shuffle partitions grow with the tables in ``folder``, so that what a task holds does not.

    Small neighbours are merged at run time. Up to the session's own number nothing changes.
    """
    if spark.conf.get(ADVISORY, "64m") == "64m":
        spark.conf.set(ADVISORY, READ_BYTES)
    wanted = -(-folder_bytes(spark, folder) // INPUT_BYTES)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL, str(wanted))
    else:
        spark.conf.unset(INITIAL)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", scratch: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark; ``scratch`` is its spark.checkpoint.dir."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trailmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    return configure(builder.getOrCreate())
