"""What a task holds must not grow with the tables: partition counts and plans."""

import time

from pyspark.sql import functions as F

from trailmark import session
from trailmark.models import ease, neighbours
from trailmark.operators import cooccurrence, grammar, profiling, sampling
from trailmark.sources import driver_tables
from trailmark.storage import materialise


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_shuffle_partitions_grow_with_the_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "INPUT_BYTES", 1000)
    (tmp_path / "t.parquet").write_bytes(b"x" * 9500)
    try:
        session.scale_to(spark, str(tmp_path))
        assert spark.conf.get(session.INITIAL) == "10"
        (tmp_path / "t.parquet").write_bytes(b"x" * 100)
        session.scale_to(spark, str(tmp_path))
        assert spark.conf.get(session.INITIAL, None) is None
    finally:
        spark.conf.unset(session.INITIAL)


def test_scale_to_keeps_a_named_size(spark, tmp_path):
    spark.conf.set(session.ADVISORY, "3m")
    try:
        session.scale_to(spark, str(tmp_path / "none"))
        assert spark.conf.get(session.ADVISORY) == "3m"
    finally:
        spark.conf.unset(session.ADVISORY)


def test_dataset_summary_holds_no_two_distinct_columns(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), (None, "y"), ("b", "y")], "user_id string, item_id string")
    result = profiling.dataset_summary(rows)
    assert "Expand" not in plan_of(result)
    got = result.first()
    assert (got["events"], got["users"], got["items"], got["sparsity"]) == (5, 2, 2, -0.25)
    assert (got["per_user_min"], got["per_user_max"], got["per_user_median"]) == (1, 3, 1.0)
    empty = profiling.dataset_summary(rows.limit(0)).first()
    assert (empty["events"], empty["users"], empty["sparsity"], empty["per_item_max"]) == (0, 0, 1.0, None)


def test_distinct_counts_per_group(spark):
    data = [("p", 1, "a"), ("p", 1, "b"), ("p", None, "b"), (None, 2, "a"), (None, 3, None), ("q", None, None)]
    frame = spark.createDataFrame(data, "g string, n int, word string")
    result = profiling.distinct_counts(frame, "g", {"ns": "n", "words": "word"})
    assert {r["g"]: (r["ns"], r["words"]) for r in result.collect()} == {"p": (1, 2), None: (2, 1), "q": (0, 0)}


def test_grammar_and_profile_hold_no_two_distinct_columns(spark):
    data = [("p", 1, "n1.000", 5), ("p", 2, "7", 6), (None, 2, None, 7), ("q", 3, "7 8", 8)]
    values = grammar.classify_values(spark.createDataFrame(data, "property string, itemid long, value string, timestamp long"))
    for result in (grammar.grammar_summary(values), grammar.property_profile(values)):
        assert "Expand" not in plan_of(result)
    got = {r["property"]: (r["rows"], r["items"], r["distinct_values"]) for r in grammar.property_profile(values).collect()}
    assert got == {"p": (2, 2, 2), None: (1, 1, 0), "q": (1, 1, 1)}


def test_part_values_are_made_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(driver_tables, "PART_ROWS", 10)
    part = spark.range(100).select(
        F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(3).alias("p_size"), F.lit(1.5).alias("p_retailprice")
    )
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    values = driver_tables.part_values(spark, str(tmp_path))
    sizes = [r["n"] for r in values.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 800 and len(sizes) > 5 and max(sizes) <= 8 * 30


def exchanges(frame):
    return [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_item_pairs_are_not_shuffled(spark):
    data = [(f"u{u}", f"i{i:02}") for u in range(12) for i in range(20) if (u * i + i) % 3]
    frame = spark.createDataFrame([*data, (None, "i01"), (None, "i02"), ("u1", None)], "u string, i string")
    met = cooccurrence.cooccurrence(frame, "u", "i")
    near = cooccurrence.cosine_neighbours(frame, "u", "i", None, 4)
    for result in (met, near):
        assert not any("_i" in line and "_j" in line for line in exchanges(result))
    users = {i: {u for u, j in data if j == i} for _, i in data}
    both = {(a, b): len(users[a] & users[b]) for a in users for b in users if a != b and users[a] & users[b]}
    assert {(r["item_i"], r["item_j"]): r["dot"] for r in met.collect()} == {(a, b): float(n) for (a, b), n in both.items() if a < b}
    got = {}
    size = lambda i: sum(j == i for _, j in data) + (i in ("i01", "i02"))
    for r in near.collect():
        got.setdefault(r["item"], {})[r["rank"]] = (r["neighbour"], r["similarity"])
    for a, ranked in got.items():
        best = sorted((-int(n / (size(a) ** 0.5 * size(b) ** 0.5) * 1e12 + 0.5), b) for (x, b), n in both.items() if x == a)[:4]
        assert [ranked[k + 1] for k in range(len(best))] == [(b, -s / 1e12) for s, b in best]


def test_meetings_decide_the_number_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "TASK_MEETINGS", 50)
    frame = spark.createDataFrame([(u, i) for u in range(5) for i in range(10)], "u int, i int")
    assert any("_i" in line and ", 11)" in line for line in exchanges(cooccurrence.cooccurrence(frame, "u", "i")))


def test_item_lists_are_shuffled_strip_by_strip(spark, monkeypatch):
    """What lies on disk of item lists at a time follows the rows, not the pairs; neighbours and votes are the same in one strip and in many."""
    data = [(f"u{u}", f"i{i:02}") for u in range(15) for i in range(20) if (u * i + i) % 3]
    frame = spark.createDataFrame([*data, (None, "i01"), ("u1", None)], "user_id string, item_id string")
    asked = spark.createDataFrame([("u1",), ("u7",), ("u11",), ("nobody",)], "user_id string")
    weighed = frame.withColumn("w", F.length("item_id") + F.ascii(F.substring("item_id", 3, 1)) / 7)
    results = lambda: [
        sorted(tuple(map(str, r)) for r in got.collect())
        for got in (
            neighbours.item_knn(frame, asked, 4, 6),
            cooccurrence.cosine_neighbours(weighed, "user_id", "item_id", "w", 3),
            cooccurrence.cosine_neighbours(frame, "user_id", "item_id", None, 3, group_items=4),
        )
    ]
    whole, stored = results(), []
    for module in (cooccurrence, neighbours):
        monkeypatch.setattr(module, "materialise", lambda part, label, *a, _m=module.materialise, **b: stored.append(label) or _m(part, label, *a, **b))
    monkeypatch.setattr(cooccurrence, "STRIP_MEETINGS", 1)
    assert results() == whole and stored.count("elected") == 2 and stored.count("strip") >= 9
    monkeypatch.undo()
    assert cooccurrence.strip_count(10_000_000_000, 300_000_000) == 9 and cooccurrence.strip_count(100, 5) == 1


def test_stored_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = shuffles()
    materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before


def test_draws_are_not_shuffled(spark, monkeypatch):
    data = [(u, i) for u in range(6) for i in range(9) if (u + i) % (u + 2)]
    frame = spark.createDataFrame(data, "user_index long, item_index long")
    lists = sampling.negatives_bounded(frame, 9)
    few = {tuple(r) for r in lists.collect()}
    monkeypatch.setattr(sampling, "LIST_ITEMS", 6)
    mixed = sampling.negatives_bounded(frame, 9)
    monkeypatch.setattr(sampling, "LIST_ITEMS", 0)
    rows = {tuple(r) for r in sampling.negatives_bounded(frame, 9).collect()}
    assert few == rows == {tuple(r) for r in mixed.collect()} and len(few) > len(data)
    assert not {(u, n) for u, _, n, _ in few} & set(data)


def test_residual_products_are_dealt_by_user(spark, monkeypatch):
    monkeypatch.setattr(ease, "TASK_MEETINGS", 4)
    history = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "a"), ("w", "b")], "user_id string, item_id string")
    # G + 1 is 3, 1 / 1, 3, its inverse 3, -1 / -1, 3 over 8; the last entry is 0.125 too large
    columns = spark.createDataFrame([("a", "a", 0.375), ("a", "b", -0.125), ("b", "a", -0.125), ("b", "b", 0.5)], "i string, j string, value double")
    history, columns = materialise(history, "history"), materialise(columns, "columns")
    result = ease.gram_residuals(history, columns, 1.0)
    assert any("user_id" in line and ", 3)" in line for line in exchanges(result))
    got = {r["item_id"]: r["residual"] for r in result.collect()}
    assert abs(got["a"]) < 1e-12 and abs(got["b"] - 0.375) < 1e-12
