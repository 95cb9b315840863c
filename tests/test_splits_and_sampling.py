"""Splits, truth tables, encodings and negative sampling."""

import random

import pytest
from pyspark.sql import functions as F

from trailmark.functions.columns import permuted
from trailmark.operators import sampling, splits
from trailmark.operators.free_places import free_places

ORDER = ["timestamp", "user_id", "item_id"]


def interactions(spark, pairs):
    rows = [(u, i, t + 1) for t, (u, i) in enumerate(pairs)]
    return spark.createDataFrame(rows, "user_id string, item_id string, timestamp long")


def sizes(split):
    return {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}


def drawn_pairs(seed, users, items, rows):
    rng = random.Random(seed)
    return [(f"v{rng.randrange(users)}", f"p{rng.randrange(items)}") for _ in range(rows)]


def test_holdout_sizes_and_warm_truth(spark):
    pairs = drawn_pairs(11, 30, 25, 90)
    split = splits.split_holdout(interactions(spark, pairs).repartition(3), ORDER, 0.2)
    assert sizes(split) == {"train": 72, "test": 18}
    assert splits.cutoffs(split).first()["cutoff"] == 72
    early, late = pairs[:72], pairs[72:]
    known_users, known_items = {u for u, _ in early}, {i for _, i in early}
    expected = {(u, i) for u, i in late if u in known_users and i in known_items}
    train, test = splits.part(split, "train"), splits.part(split, "test")
    assert {(r["user_id"], r["item_id"]) for r in splits.warm_truth(train, test).collect()} == expected
    assert 0 < len(expected) < 18


def test_three_way_sizes(spark):
    frame = interactions(spark, drawn_pairs(12, 9, 14, 20))
    split = splits.split_three_way(frame.repartition(4), ORDER)
    assert sizes(split) == {"train": 14, "validation": 3, "test": 3}
    cut = {r["split"]: r["cutoff"] for r in splits.cutoffs(split).collect()}
    assert cut["train"] < cut["validation"] < 20
    train, truth = splits.part(split, "train"), splits.warm_truth(splits.part(split, "train"), splits.part(split, "test"))
    known = train.toPandas()
    assert all(r["user_id"] in set(known.user_id) and r["item_id"] in set(known.item_id) for r in truth.collect())
    with pytest.raises(ValueError, match="timestamp"):
        splits.temporal_holdout(frame.drop("timestamp"))


def test_positional_bounds():
    assert splits.positional_bounds(100, 0.7, 0.15) == (70, 85)
    assert splits.positional_bounds(90)[0] == 62  # int(90 * 0.7) in double arithmetic
    # too few rows, or a part left empty
    for n, train, val in ((2, 0.7, 0.15), (3, 0.7, 0.15), (4, 0.99, 0.005)):
        with pytest.raises(ValueError):
            splits.positional_bounds(n, train, val)


def test_ties_split_alike_on_every_run(spark):
    rows = [(f"u{i % 7}", f"i{i}", 5) for i in range(50)]
    frame = spark.createDataFrame(rows, "user_id string, item_id string, timestamp long")
    picks = [
        sorted(r["item_id"] for r in splits.split_holdout(f, ORDER, 0.3).filter("split = 'test'").collect())
        for f in (frame, frame.repartition(6), frame.orderBy(F.desc("item_id")))
    ]
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 15


def test_user_tail(hot):
    rows = [("a", f"i{i}", i) for i in range(100)] + [("b", "x", 1)] + [("c", f"j{i}", i) for i in range(7)]
    frame = hot.createDataFrame(rows, "visitorid string, item_id string, timestamp long")
    split = splits.split_user_tail(frame, ["timestamp", "item_id"])
    got = {(r["visitorid"], r["split"]): r["count"] for r in split.groupBy("visitorid", "split").count().collect()}
    assert got == {("a", "train"): 80, ("a", "validation"): 20, ("b", "validation"): 1, ("c", "train"): 6, ("c", "validation"): 1}
    edge = split.filter("visitorid = 'a' and split = 'validation'").agg(F.min("timestamp")).first()[0]
    assert edge == 80


def test_evaluable_truth(spark):
    train = spark.createDataFrame([("1", "10"), ("3", "99"), ("9", "11"), ("9", "12")], "user_id string, item_id string")
    test = spark.createDataFrame([("1", "10"), ("1", "11"), ("2", "12"), ("3", "13")], "user_id string, item_id string")
    assert [tuple(r) for r in splits.evaluable_truth(train, test).collect()] == [("1", "11")]


@pytest.fixture
def seen(spark):
    pairs = [(0, i) for i in (0, 2, 4)] + [(1, i) for i in range(5)] + [(2, 3)]
    return spark.createDataFrame(pairs, "user_index long, item_index long")


def test_negatives_per_user(seen):
    rows = sampling.negatives_per_user(seen, 5, n=80).collect()
    drawn = {}
    for r in rows:
        drawn.setdefault(r["user_index"], []).append(r["item_index"])
    assert {u: len(v) for u, v in drawn.items()} == {0: 80, 2: 80}  # user 1 has seen everything
    assert set(drawn[0]) == {1, 3} and set(drawn[2]) == {0, 1, 2, 4}
    assert min(drawn[2].count(i) for i in (0, 1, 2, 4)) > 8
    again = sampling.negatives_per_user(seen.repartition(5), 5, n=80).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


@pytest.mark.parametrize("catalogue", [8, 60])
def test_negatives_per_positive(seen, catalogue):
    rows = [tuple(r) for r in sampling.negatives_per_positive(seen, catalogue, n=4).collect()]
    assert len(rows) == len(set(rows))
    assert not set(rows) & {tuple(r) for r in seen.collect()}
    held = {0: 3, 1: 5, 2: 1}
    expected = {u: min(4 * n, catalogue - n) for u, n in held.items()}
    assert {u: sum(r[0] == u for r in rows) for u in held} == expected


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 17, 1000])
def test_permuted_ranks_hit_every_number_once(spark, size):
    rows = spark.range(size).withColumn("user", F.lit(5)).select("user", permuted(1, "user", F.col("id"), F.lit(size)).alias("x"), permuted(1, "id", F.col("id"), F.lit(size)).alias("other"))
    got = rows.collect()
    assert sorted(r["x"] for r in got) == list(range(size))
    assert all(0 <= r["other"] < size for r in got)
    if size == 1000:
        assert sum(r["x"] < 500 for r in got[:500]) in range(200, 300)


def test_free_places(hot):
    rng = random.Random(4)
    taken = {u: sorted(rng.sample(range(300), n)) for u, n in enumerate((0, 1, 40, 250))}
    asks = [(u, r) for u in taken for r in (0, 0, 3, 17, 49, 1000)]
    held = hot.createDataFrame([(u, p) for u, ps in taken.items() for p in ps], "u long, place long")
    got = free_places(hot.createDataFrame(asks, "u long, r long").withColumn("more", F.lit("x")), held, "u", "r", "place")
    free = {u: [p for p in range(2000) if p not in ps] for u, ps in taken.items()}
    assert sorted((r["u"], r["r"], r["place"]) for r in got.collect()) == sorted((u, r, free[u][r]) for u, r in asks)
    few = free_places(hot.createDataFrame([a for a in asks if a[1] < 20], "u long, r long"), held, "u", "r", "place", most=19)
    assert sorted(map(tuple, few.collect())) == sorted((u, r, free[u][r]) for u, r in asks if r < 20)


def test_added_item_keeps_the_number_of_draws(seen):
    count = lambda n: {r["user_index"]: r["count"] for r in sampling.negatives_per_positive(seen, n, n=2).groupBy("user_index").count().collect()}
    assert count(15) == count(16) == {0: 6, 1: 10, 2: 2}


def test_other_samplers(seen):
    positives = {tuple(r) for r in seen.collect()}
    triplets = sampling.negatives_bounded(seen, 5, n=2).collect()
    assert all((r["user_index"], r["negative_index"]) not in positives for r in triplets)
    assert {(r["user_index"], r["positive_index"]) for r in triplets} == {p for p in positives if p[0] != 1}
    pairs = sampling.random_negatives(seen, 3, 5, 12).collect()
    assert len(pairs) == 12 and all((r["user_index"], r["item_index"]) not in positives for r in pairs)
    labelled = sampling.labelled_pairs(seen, 5, n=4)
    assert labelled.filter("label = 1").count() == 9 and labelled.filter("label = 0").count() == 8
    with pytest.raises(ValueError):
        sampling.labelled_pairs(seen.limit(0), 5)
