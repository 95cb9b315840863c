"""Cleaning, sampling, sources and sinks on small literals."""

import pytest
from pyspark.sql import functions as F

from trailmark.operators import cleaning, encoding
from trailmark.sources import readers, writers

EVENTS = "timestamp long, visitorid long, event string, itemid long, transactionid double"


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(
        [
            (1000, 1, "view", 10, None),
            (2000, 1, "addtocart", 10, None),
            (3000, 2, "transaction", 11, 7.0),
            (4000, 2, "other", 11, None),
            (None, 3, "view", 12, None),
        ],
        EVENTS,
    )


def test_normalize(raw):
    rows = {r["timestamp"]: r for r in cleaning.normalize_events(raw).collect()}
    assert {t: r["event_weight"] for t, r in rows.items()} == {1000: 1.0, 2000: 3.0, 3000: 5.0}
    assert rows[1000]["visitorid"] == "1" and rows[3000]["transactionid"] == 7.0
    with pytest.raises(ValueError, match="itemid"):
        cleaning.normalize_events(raw.drop("itemid"))


def test_catalog_filter_needs_several_rounds(spark):
    data = [("u1", "a")] * 3 + [("u1", "b")] + [("u2", "a")] * 2 + [("u2", "c")] * 2 + [("u3", "b")] * 2 + [("u3", "d")] * 3 + [("u4", "c"), ("u4", "b")]
    frame = spark.createDataFrame(data, "visitorid string, itemid string")

    def reference(rows, n, m):
        while True:
            before = len(rows)
            counts = {}
            for _, i in rows:
                counts[i] = counts.get(i, 0) + 1
            keep = set(sorted(counts, key=lambda i: (-counts[i], i))[:n]) if n > 0 else set(counts)
            rows = [r for r in rows if r[1] in keep]
            sizes = {}
            for u, _ in rows:
                sizes[u] = sizes.get(u, 0) + 1
            rows = [r for r in rows if m <= 0 or sizes[r[0]] >= m]
            if len(rows) == before:
                return sorted(rows)

    for n, m in ((3, 3), (2, 4), (0, 3), (2, 0), (0, 0), (1, 9)):
        got = sorted(map(tuple, cleaning.catalog_filter(frame, n, m).collect()))
        assert got == reference(data, n, m), (n, m)


def test_top_keys_beyond_the_list_limit(monkeypatch, spark):
    totals = spark.createDataFrame([(f"k{i:02}", i % 5) for i in range(40)], "key string, n long")
    small = sorted(r["key"] for r in cleaning.top_keys(totals, "key", "n", 11).collect())
    monkeypatch.setattr(cleaning, "TOP_LIST_ROWS", 3)
    assert sorted(r["key"] for r in cleaning.top_keys(totals, "key", "n", 11).collect()) == small


def test_dedupe_keeps_first(spark):
    frame = spark.createDataFrame([("u", "i", 5, "b"), ("u", "i", 3, "a"), ("u", "j", 9, "c")], "user_id string, item_id string, timestamp long, x string")
    assert sorted(map(tuple, cleaning.dedupe_first(frame).collect())) == [("u", "i", 3, "a"), ("u", "j", 9, "c")]
    assert cleaning.dedupe_first(frame.drop("timestamp", "x"), time=None).count() == 2


def test_resolve_columns(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "userId long, item long, ts long")
    assert cleaning.resolve_columns(frame).columns == ["user_id", "item_id", "timestamp"]
    assert cleaning.resolve_columns(frame.toDF("a", "b", "c")).columns == ["user_id", "item_id"]
    with pytest.raises(ValueError):
        cleaning.resolve_columns(frame.select(F.col("ts").alias("a")))


def test_samples_are_exact_and_stable(spark):
    frame = spark.range(500).select("id", (F.col("id") % 20).alias("visitorid"))
    first = {r["id"] for r in cleaning.sample_rows(frame, 37, 42, ["id"]).collect()}
    again = {r["id"] for r in cleaning.sample_rows(frame.repartition(7), 37, 42, ["id"]).collect()}
    assert len(first) == 37 and first == again
    assert first != {r["id"] for r in cleaning.sample_rows(frame, 37, 1, ["id"]).collect()}
    assert cleaning.sample_rows(frame, 0, 42, ["id"]).count() == 500
    assert cleaning.sample_entities(frame, "visitorid", 3, 42).count() == 75


def test_ids_are_encoded_in_string_order(spark):
    frame = spark.createDataFrame([("10",), ("9",), ("2",), ("9",)], "visitorid string")
    assert {r["id"]: r["idx"] for r in encoding.id_table(frame, "visitorid").collect()} == {"10": 0, "2": 1, "9": 2}


def test_sources_and_sinks(spark, tmp_path):
    events = tmp_path / "events.csv"
    events.write_text("timestamp,visitorid,event,itemid,transactionid\n1000,1,view,5,\n2000,2,transaction,6,9\n3000,1,noise,5,\n500,1,view,5,\n")
    assert readers.read_events(spark, str(events)).columns == ["timestamp", "visitorid", "event", "itemid"]
    assert readers.read_positive_events(spark, str(events)).count() == 3
    assert str(readers.read_timed_events(spark, str(events)).orderBy("timestamp").first()["event_time"]) != ""
    with pytest.raises(ValueError, match="color"):
        readers.read_events(spark, str(events), ["timestamp", "color"])
    assert {tuple(r) for r in readers.load_interactions(spark, str(tmp_path)).collect()} == {("1", "5", 500), ("2", "6", 2000)}

    for part in (1, 2):
        (tmp_path / f"p{part}.txt").write_text(f"timestamp,itemid,property,value\n{part},1,available,1\n{part},2,available,0\n")
    paths = [str(tmp_path / f"p{p}.txt") for p in (1, 2)]
    assert readers.read_properties(spark, paths).count() == 4
    assert readers.read_properties(spark, paths, rows_per_file=1).count() == 2
    (tmp_path / "tree.txt").write_text("categoryid,parentid\n1,\n2,1\n")
    assert readers.read_category_tree(spark, str(tmp_path / "tree.txt")).filter("parentid is null").count() == 1
    assert readers.missing_inputs(spark, str(tmp_path), ["events.csv", "nothing.csv"]) == ["nothing.csv"]

    table = spark.createDataFrame([("u", "i", 4)], "user_id string, item_id string, timestamp long")
    writers.write_parquet(table, str(tmp_path / "interactions.parquet"))
    assert readers.load_interactions(spark, str(tmp_path)).first()["user_id"] == "u"
    assert readers.read_interactions(spark, str(tmp_path / "interactions.parquet")).count() == 1
    ids = encoding.id_table(table, "user_id")
    writers.write_id_tables(ids, ids, str(tmp_path / "ids"))
    assert writers.entity_counts(spark, str(tmp_path / "ids")) == (1, 1)
    writers.write_json(table, str(tmp_path / "stats.json"))
    comparison = spark.createDataFrame([("a", 0.1), ("b", 0.4)], "model string, harmonic_mean_at_10 double")
    writers.write_comparison(comparison, str(tmp_path / "comparison"))
    assert readers.reference_metric(spark, str(tmp_path / "comparison")) == 0.4
    assert readers.reference_metric(spark, str(tmp_path / "absent.csv")) is None
    with pytest.raises(FileNotFoundError):
        readers.load_interactions(spark, str(tmp_path / "empty"))
