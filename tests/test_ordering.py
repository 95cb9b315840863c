"""Order primitives against plain Python, with and without hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import ordering
from trailmark.operators.ordering import Lanes, dense_index, keys_at_ranks, percentiles, running_totals, split_at


@pytest.fixture
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(12)}"
        data.append((key, rng.randrange(60), i, rng.choice([None, "a", "b"]), rng.randrange(5)))
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "key string, t long, id long, word string, n long").repartition(6)


def by_key(data):
    groups = {}
    for row in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("limit", ["1000000", "20", "7"])
def test_lanes_match_sequential_scan(spark, rows, limit):
    data, frame = rows
    spark.conf.set("spark.trailmark.hotGroupRows", limit)
    try:
        lanes = Lanes(frame, ["key"], ["t", "id"])
        assert lanes.split == (limit != "1000000")
        lanes.neighbour({"before": "id", "word_before": "word"}, -1).neighbour({"after": "id"}, 1)
        lanes.running_sum("total", "n").row_number("nth").last_known({"word_now": "word"})
        lanes.last_known({"word_earlier": "word"}, inclusive=False)
        got = {r["id"]: r for r in lanes.result().collect()}
    finally:
        spark.conf.unset("spark.trailmark.hotGroupRows")
    assert len(got) == len(data)
    for group in by_key(data).values():
        total, last = 0, None
        for i, (_, _, ident, word, n) in enumerate(group):
            row = got[ident]
            total += n
            assert row["before"] == (group[i - 1][2] if i else None)
            assert row["word_before"] == (group[i - 1][3] if i else None)
            assert row["after"] == (group[i + 1][2] if i + 1 < len(group) else None)
            assert (row["total"], row["nth"]) == (total, i + 1)
            assert row["word_earlier"] == last
            last = word if word is not None else last
            assert row["word_now"] == last


def test_hot_key_is_cut_into_bounded_lanes(hot, rows):
    _, frame = rows
    lanes = Lanes(frame, ["key"], ["t", "id"])
    sizes = lanes.frame.filter("key = 'hot'").groupBy("_lane").count().collect()
    assert len(sizes) >= 10 and max(r["count"] for r in sizes) < 300


def test_many_cuts_per_key(spark):
    spark.conf.set("spark.trailmark.hotGroupRows", "5")
    try:
        frame = spark.range(2000).select(F.lit("x").alias("key"), F.col("id").alias("t"))
        lanes = Lanes(frame, ["key"], ["t"]).row_number("nth")
        assert lanes.frame.select("_lane").distinct().count() > ordering.CUTS_PER_BLOCK
        assert lanes.result().filter("nth <> t + 1").count() == 0
    finally:
        spark.conf.unset("spark.trailmark.hotGroupRows")


def test_dense_index(rows):
    data, frame = rows
    got = {r["id"]: r["pos"] for r in dense_index(frame, ["t", "id"], "pos").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda p: p[1])] == [r[2] for r in sorted(data, key=lambda r: (r[1], r[2]))]
    assert sorted(got.values()) == list(range(len(data)))


def test_running_totals(rows):
    data, frame = rows
    got = {r["id"]: r["upto"] for r in running_totals(frame, ["t", "id"], {"upto": "n"}).collect()}
    total = 0
    for row in sorted(data, key=lambda r: (r[1], r[2])):
        total += row[4]
        assert got[row[2]] == total


@pytest.mark.parametrize("driver_rows", [50_000, 40, 1])
def test_rank_search(monkeypatch, rows, driver_rows):
    monkeypatch.setattr(ordering, "DRIVER_ROWS", driver_rows)
    monkeypatch.setattr(ordering, "PIVOT_SAMPLE", 60)
    data, frame = rows
    ordered = sorted((r[1], r[2]) for r in data)
    found = keys_at_ranks(frame, ["t", "id"], [0, 17, 450, 899])
    assert {k: v.key for k, v in found.items()} == {k: ordered[k] for k in (0, 17, 450, 899)}
    coarse = keys_at_ranks(frame, ["t"], [0, 450, 899])
    times = sorted(r[1] for r in data)
    for rank, at in coarse.items():
        assert (at.key[0], at.before, at.copies) == (times[rank], times.index(times[rank]), times.count(times[rank]))
    with pytest.raises(ValueError):
        keys_at_ranks(frame, ["t"], [900])


@pytest.mark.parametrize("cuts", [[300], [10, 600], [0, 900], [450, 450]])
def test_split_at_is_exact_even_with_copies(spark, cuts):
    frame = spark.createDataFrame([(i % 4,) for i in range(900)], "t long").repartition(5)
    parts = split_at(frame, ["t"], cuts, "part").groupBy("part").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).collect()
    edges = [0, *cuts, 900]
    expected = {i: b - a for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a}
    assert {r["part"]: r["n"] for r in parts} == expected
    bounds = sorted((r["part"], r["lo"], r["hi"]) for r in parts)
    assert all(a[2] <= b[1] for a, b in zip(bounds, bounds[1:]))


def test_percentiles(spark):
    frame = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 10]] + [(None,)], "v double")
    assert percentiles(frame, "v", [0.5, 0.9]) == {0.5: 3.0, 0.9: pytest.approx(7.6)}
    assert percentiles(frame, "v", [0.9], "nearest") == {0.9: 10.0}
    assert percentiles(frame.filter("v > 99"), "v", [0.5]) == {0.5: None}


def test_running_totals_of_fractions(spark):
    frame = spark.range(50).selectExpr("id", "id * 0.5D AS half", "id AS whole").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = running_totals(frame, ["id"], {"halves": "half", "wholes": "whole"}).orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [(r.halves, r.wholes) for r in rows] == [(i * (i + 1) / 4, i * (i + 1) // 2) for i in range(50)]


@pytest.mark.parametrize("driver_rows", [1, 50_000])
@pytest.mark.parametrize("parts", [1, 2, 4])
def test_split_with_ties_and_nulls(spark, monkeypatch, parts, driver_rows):
    monkeypatch.setattr(ordering, "DRIVER_ROWS", driver_rows)
    monkeypatch.setattr(ordering, "PIVOT_SAMPLE", 50)
    rows = [(None if i % 3 == 0 else min(i // 4, 60), i % 400, f"v{i % 400}") for i in range(600)]
    order = random.Random(parts).sample(rows, len(rows))
    frame = spark.createDataFrame(order, "t int, _part int, v string").repartition(parts)
    got = split_at(frame, ["t"], [100, 420, 500], "part")
    counts = {r.part: r.n for r in got.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 100, 1: 320, 2: 80, 3: 100}
    again = split_at(frame.orderBy(F.desc("v")).coalesce(1), ["t"], [100, 420, 500], "part")
    tell = lambda f: sorted((r.t is not None, r.t or 0, r.v, r.part) for r in f.collect())
    assert tell(got) == tell(again)
    assert all(a.part <= b.part for a, b in [(x, y) for x in got.filter("t is null").collect()[:20] for y in got.filter("t > 50").collect()[:20]])


def test_internal_names_are_refused(spark):
    with pytest.raises(ValueError):
        dense_index(spark.range(3).withColumn("_tm_part", F.lit(1)), ["id"], "n")


def test_hot_null_keys_are_cut(hot):
    rng = random.Random(31)
    rows = [(None if i % 2 else rng.randrange(60), i, rng.randrange(9)) for i in range(1500)]
    frame = hot.createDataFrame(rows, "k int, t int, v int").repartition(5)
    lanes = Lanes(frame, ["k"], ["t"])
    sizes = lanes.result(), lanes.frame.groupBy("k", "_lane").agg(F.count("*").alias("n")).collect()
    assert max(r.n for r in sizes[1]) <= 100 and sum(r.k is None for r in sizes[1]) > 5
    out = lanes.neighbour({"before": "v"}, -1).running_sum("total", "v").row_number("nth").result().orderBy("t").collect()
    last, total, nth = {}, {}, {}
    for r in out:
        total[r.k], nth[r.k] = total.get(r.k, 0) + r.v, nth.get(r.k, 0) + 1
        assert (r.before, r.total, r.nth) == (last.get(r.k), total[r.k], nth[r.k])
        last[r.k] = r.v


def test_rank_search_fetches_a_row_for_every_range_it_is_in(spark):
    frame = spark.range(100).select("id")
    spans = [ordering._Range((9,), (50,), 10, 40), ordering._Range((19,), (60,), 20, 40)]
    low, high = ordering._fetch(frame, ["id"], spans, [1.0, 1.0], 1)
    assert sorted(low) == [(i,) for i in range(10, 50)]
    assert sorted(high) == [(i,) for i in range(20, 60)]
