"""Sessions, transitions, point-in-time joins and the value grammar."""

import random

import pandas as pd
import pytest

from trailmark.functions.columns import behaviour_profile, bin_label, right_closed_bin
from trailmark.operators import grammar, sessions, temporal
from pyspark.sql import functions as F

SCHEMA = "event_id long, visitorid long, event string, itemid long, timestamp long"
MINUTE = 60_000


def events(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def test_session_rules(spark):
    rows = [(1, "view", 1, 0), (1, "view", 1, 29), (1, "view", 1, 59), (1, "transaction", 1, 60), (1, "transaction", 1, 61), (1, "view", 1, 62)]
    frame = events(spark, [(v, e, i, t * MINUTE) for v, e, i, t in rows])
    got = [r["session_index"] for r in sessions.sessionize(frame).orderBy("event_id").collect()]
    assert got == [1, 1, 2, 2, 2, 3]
    gap_only = [r["session_index"] for r in sessions.sessionize(frame, purchase_ends=False).orderBy("event_id").collect()]
    assert gap_only == [1, 1, 2, 2, 2, 2]


def _random_events(spark, n=600):
    rng = random.Random(5)
    kinds = ["view", "view", "addtocart", "transaction"]
    rows = [(0 if i % 3 == 0 else rng.randrange(8), rng.choice(kinds), rng.randrange(6), rng.randrange(40) * 17 * MINUTE) for i in range(n)]
    return events(spark, rows)


@pytest.mark.parametrize("limit", [None, "25"])
def test_sessions_with_ties_and_hot_visitor(spark, limit):
    frame = _random_events(spark)
    if limit:
        spark.conf.set("spark.trailmark.hotGroupRows", limit)
    try:
        got = sessions.sessionize(frame.repartition(8)).select("event_id", "session_index").toPandas().set_index("event_id")["session_index"]
        one = sessions.sessionize(frame.coalesce(1)).select("event_id", "session_index").toPandas().set_index("event_id")["session_index"]
    finally:
        spark.conf.unset("spark.trailmark.hotGroupRows")
    pdf = frame.toPandas().sort_values(["visitorid", "timestamp", "itemid", "event", "event_id"])
    previous = pdf.groupby("visitorid")[["timestamp", "event"]].shift(1)
    starts = previous["timestamp"].isna() | (pdf["timestamp"] - previous["timestamp"] >= 30 * MINUTE)
    starts |= previous["event"].eq("transaction") & pdf["event"].ne("transaction")
    expected = starts.astype(int).groupby(pdf["visitorid"]).cumsum()
    expected.index = pdf["event_id"]
    assert got.sort_index().tolist() == expected.sort_index().tolist() == one.sort_index().tolist()


def test_transitions(spark):
    frame = events(spark, [(1, "view", 1, 0), (1, "view", 1, 1), (1, "addtocart", 1, 2), (1, "transaction", 2, 3)])
    rows = sessions.transitions(frame).collect()
    assert len(rows) == 9
    assert {(r["event"], r["next_event"]) for r in rows if r["all_items"]} == {("view", "view"), ("view", "addtocart"), ("addtocart", "transaction")}
    assert sum(r["same_item"] for r in rows) == 2
    for event in ("view", "addtocart", "transaction"):
        total = sum(r["all_items_pct"] for r in rows if r["event"] == event)
        assert total == (0.0 if event == "transaction" else 100.0)


def test_asof_join_example(spark):
    base = events(spark, [(1, "view", 1, t) for t in (5, 10, 15, 20, 99)] + [(1, "view", 2, 50)])
    changes = spark.createDataFrame(
        [(10, 1, "categoryid", "v1", 1), (20, 1, "categoryid", "v2", 2)], "timestamp long, itemid long, property string, value string, change_id long"
    )
    rows = temporal.asof_properties(base, changes).orderBy("event_id").collect()
    assert [r["categoryid_asof"] for r in rows] == [None, "v1", "v1", "v2", "v2", None]
    assert [r["categoryid_asof_time"] for r in rows] == [None, 10, 10, 20, 20, None]
    assert temporal.asof_properties(base, changes.limit(0)).filter("available_asof is not null").count() == 0


@pytest.mark.parametrize("limit", [None, "25"])
def test_asof_join_against_pandas(spark, limit):
    rng = random.Random(9)
    base = events(spark, [(1, "view", 0 if i % 3 == 0 else rng.randrange(9), rng.randrange(500)) for i in range(400)])
    data = [(rng.randrange(500), rng.randrange(8), "available", str(rng.randrange(2)), i) for i in range(300)]
    changes = spark.createDataFrame(data, "timestamp long, itemid long, property string, value string, change_id long")
    if limit:
        spark.conf.set("spark.trailmark.hotGroupRows", limit)
    try:
        got = temporal.asof_properties(base, changes, {"available": "v"}).toPandas().sort_values("event_id")
    finally:
        spark.conf.unset("spark.trailmark.hotGroupRows")
    left = base.toPandas().sort_values(["timestamp", "event_id"])
    right = changes.toPandas().sort_values(["timestamp", "change_id"]).rename(columns={"timestamp": "t"})
    expected = pd.merge_asof(left, right, left_on="timestamp", right_on="t", by="itemid").sort_values("event_id")
    assert got["v"].where(got["v"].notna(), None).tolist() == expected["value"].where(expected["value"].notna(), None).tolist()
    assert (got["v_time"].dropna() <= got["timestamp"][got["v_time"].notna()]).all()


def test_super_table_has_no_future_values(hot):
    base = _random_events(hot, 300).withColumnRenamed("event_id", "source_id").withColumn("transactionid", F.lit(None).cast("long"))
    changes = hot.createDataFrame(
        [(i * 13 * MINUTE, i % 6, "categoryid" if i % 2 else "available", str(i % 4), i) for i in range(60)],
        "timestamp long, itemid long, property string, value string, change_id long",
    )
    tree = hot.createDataFrame([(0, None), (1, 0), (2, 0)], "categoryid long, parentid long")
    table = temporal.super_event_table(base, changes, tree)
    audit = temporal.join_audit(table, tree).first()
    assert audit["event_rows"] == 300 and audit["event_id_unique"] == 1
    assert audit["categoryid_asof_future_rows"] == audit["available_asof_future_rows"] == 0
    rows = table.toPandas().sort_values("event_id")
    assert rows["user_events_before"].tolist() == rows.groupby("visitorid").cumcount().tolist()
    assert rows["item_events_before"].tolist() == rows.groupby("itemid").cumcount().tolist()
    gap = (rows["timestamp"] - rows.groupby("itemid")["timestamp"].shift(1)) / MINUTE
    assert rows["item_minutes_since_previous"].fillna(-1).tolist() == gap.fillna(-1).tolist()


def test_prior_count_percentile(spark):
    frame = _random_events(spark, 200)
    expected = frame.toPandas().groupby("visitorid").cumcount().quantile(0.95)
    assert temporal.prior_count_percentile(frame, "visitorid", 0.95) == pytest.approx(expected)


def test_value_grammar(spark):
    rows = [("categoryid", "1338"), ("available", "1"), ("p", "n5.000"), ("p", "24214"), ("p", "24214 44214"), ("p", "24214 n2017.000"), ("p", "abc"), ("p", ""), ("p", None)]
    frame = spark.createDataFrame([(i, 1, p, v) for i, (p, v) in enumerate(rows)], "timestamp long, itemid long, property string, value string")
    got = [r["value_grammar"] for r in grammar.classify_values(frame).orderBy("timestamp").collect()]
    assert got == [
        "special_categoryid", "special_available", "encoded_numeric_only", "single_hashed_text_token", "multi_hashed_text_tokens",
        "mixed_hashed_text_and_numeric", "other_or_unexpected", "encoded_numeric_only", "encoded_numeric_only",
    ]
    tokens = {r["token"]: (r["token_type"], r["number"]) for r in grammar.value_token_rows(grammar.classify_values(frame)).collect()}
    assert tokens["n5.000"] == ("encoded_numeric_token", 5.0)
    assert tokens["abc"][0] == "unexpected_token" and tokens["abc"][1] is None


def test_bins_and_profiles(spark):
    frame = spark.createDataFrame([(5.0,), (5.01,), (43200.0,), (43201.0,)], "m double").withColumn("bin", right_closed_bin("m"))
    assert [r["bin"] for r in frame.collect()] == [0, 1, 7, 8]
    assert frame.select(bin_label("bin").alias("l")).first()["l"] == "(-inf, 5]"
    rows = spark.createDataFrame([(1, 0, 0), (5, 0, 0), (2, 1, 0), (3, 1, 1)], "n int, c int, b int")
    got = [r[0] for r in rows.select(behaviour_profile(F.col("n"), F.col("c"), F.col("b"))).collect()]
    assert got == ["cold_or_single_view", "recurring_browser", "cart_intent", "buyer"]
