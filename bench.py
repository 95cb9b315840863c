"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from trailmark.plans.catalog import QUERIES  # noqa: E402
from trailmark.session import local_session  # noqa: E402

HEADLINE = (
    "normalize_events",
    "dedupe_first_orders",
    "catalog_filter_orders",
    "sessionize",
    "session_stats",
    "transitions",
    "profile_summary",
    "asof_property",
    "super_event_table",
    "property_profile",
    "split_three_way_orders",
    "encode_ids",
    "negatives_per_user",
    "reco_popularity",
    "reco_popularity_unseen",
    "reco_item_knn_weighted",
    "reco_ease",
    "metrics_multi_k",
    "reco_item_knn",
    "cooccurrence_orders",
    "reco_logreg",
    "flagship_evaluation",
    "negatives_per_positive",
    "reco_ease_conjugate",
    "reco_pairwise",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = local_session(cores, shuffle_partitions=max(4, int(cores)), memory=os.environ.get("BENCH_MEMORY", "12g"), scratch=tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["event_distribution"].plan(spark, folder).count()  # start the JVM paths before timing
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name].plan(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": Path(folder).name}))


if __name__ == "__main__":
    main()
