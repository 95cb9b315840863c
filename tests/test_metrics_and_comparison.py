"""Ranking metrics, model ranking, promotion gate and batch inference."""

import threading

import pytest
from pyspark.sql import functions as F

from trailmark.models import simple
from trailmark.operators import ranking_metrics as rm
from trailmark.plans import comparison, models_catalog, registry


def lists(spark, recommended):
    rows = [(u, i, n + 1) for u, items in recommended.items() for n, i in enumerate(items)]
    return spark.createDataFrame(rows, "user_id string, item_id string, rank int")


def truth(spark, relevant):
    return spark.createDataFrame([(u, i) for u, items in relevant.items() for i in items], "user_id string, item_id string")


def test_known_values(spark):
    row = rm.per_user_metrics(lists(spark, {"u": ["10", "20", "30", "40"]}), truth(spark, {"u": ["20", "40", "50"]}), [4]).first()
    assert (row["precision"], row["hit_rate"]) == (0.5, 1.0)
    assert row["recall"] == pytest.approx(2 / 3)
    assert row["map"] == pytest.approx(0.3333, abs=1e-4)
    assert row["ndcg"] == pytest.approx(0.4982, abs=1e-4)


def test_k_is_the_denominator(spark):
    row = rm.per_user_metrics(lists(spark, {"u": ["a", "c"]}), truth(spark, {"u": ["a", "b"]}), [5]).first()
    assert row["precision"] == pytest.approx(0.2)
    with pytest.raises(ValueError):
        rm.per_user_metrics(lists(spark, {"u": ["a"]}), truth(spark, {"u": ["a"]}), [0])


def test_means_run_over_users_on_both_sides(spark):
    wide = rm.mean_metrics(lists(spark, {"u1": ["a", "b", "x"], "u2": ["c", "d", "e"]}), truth(spark, {"u1": ["a", "b"], "u2": ["c"]}), [2]).first()
    assert wide["precision"] == pytest.approx(0.75) and wide["num_users"] == 2
    one = rm.mean_metrics(lists(spark, {"u1": ["a"]}), truth(spark, {"u1": ["a"], "u2": ["c"]}), [1]).first()
    assert (one["precision"], one["num_users"], one["evaluated_users"]) == (1.0, 2, 1)
    none = rm.mean_metrics(lists(spark, {"u9": ["a"]}), truth(spark, {"u1": ["a"]}), [1, 5]).collect()
    assert [r["ndcg"] for r in none] == [0.0, 0.0]


def test_recall_grows_with_k(spark):
    rows = rm.per_user_metrics(lists(spark, {"u": list("abcdefghij")}), truth(spark, {"u": ["b", "h", "z"]}), [1, 2, 5, 10]).orderBy("k").collect()
    recalls = [r["recall"] for r in rows]
    assert recalls == sorted(recalls) and all(0 <= r[m] <= 1 for r in rows for m in rm.METRICS)


def test_auc(spark):
    def value(rows):
        return rm.auc(spark.createDataFrame(rows, "score double, label int")).first()["auc"]

    assert value([(0.1, 1), (0.9, 1)]) == 0.5
    assert value([(0.1, 0), (0.9, 1)]) == 1.0
    assert value([(0.5, 0), (0.5, 1), (0.7, 1), (0.2, 0)]) == pytest.approx(0.875)


def test_coverage(spark):
    catalogue = truth(spark, {"x": ["a", "b", "c", "d"]})
    rows = rm.catalogue_coverage(lists(spark, {"u": ["a", "b"], "v": ["a", "c"]}), catalogue, [1, 2]).orderBy("k").collect()
    assert [r["coverage"] for r in rows] == [0.25, 0.75]


def metrics(spark, values):
    rows = [(m, 10, *v) for m, v in values.items()]
    return spark.createDataFrame(rows, "model string, k int, precision double, recall double, ndcg double, map double, hit_rate double")


def test_harmonic_mean_and_ranking(spark):
    frame = metrics(spark, {"worst": (0.1,) * 5, "best": (0.5,) * 5, "mid": (0.3,) * 5, "zero": (0.4, 0.4, 0.0, 0.4, 0.4)})
    ranked = comparison.rank_models(frame).orderBy("place").collect()
    assert [r["model"] for r in ranked] == ["best", "mid", "worst", "zero"]
    assert ranked[0]["absolute_gain"] == pytest.approx(0.2) and ranked[0]["relative_gain"] == pytest.approx(2 / 3)
    assert comparison.runner_up(comparison.rank_models(frame.filter("model = 'best'"))).count() == 0
    example = metrics(spark, {"m": (0.1391, 0.5489, 0.3735, 0.2550, 0.0)})
    assert example.select(comparison.harmonic_mean()).first()[0] == pytest.approx(0.2563, abs=1e-3)
    runs = frame.withColumns({"run_name": F.concat(F.lit("compare_"), "model"), "has_artifact": F.col("model") != "best"})
    assert comparison.best_logged_run(runs).first()["model"] == "mid"


def test_gate(spark):
    candidate = spark.createDataFrame([(0.30,)], "harmonic_mean double")

    def gate(reference, **options):
        row = comparison.promotion_gate(candidate, reference, **options).first()
        return row["passed"], row["promoted"]

    assert gate(0.30) == (True, True)
    assert gate(0.31) == (True, True)
    assert gate(0.20) == (False, False)  # two-sided: too good is suspicious as well
    assert gate(0.40) == (False, False)
    assert gate(0.0) == (False, False)
    assert gate(None) == (True, True)
    assert gate(0.30, dry_run=True) == (True, False)


def test_comparison_tells_of_failing_models(spark):
    train = spark.createDataFrame([("u1", "a", 1), ("u1", "b", 2), ("u2", "a", 3)], "user_id string, item_id string, timestamp long")
    held = truth(spark, {"u1": ["a"], "u2": ["b"]})

    def broken(train, users, k):
        raise RuntimeError("no")

    models = {"popularity": lambda t, u, k: simple.popularity(t, u, k), "broken": broken}
    with pytest.raises(RuntimeError):
        comparison.compare_models(train, held, models, [1, 2])
    result = comparison.compare_models(train, held, models, [1, 10], report_failures=True)
    told = {(r["model"], r["status"], r["k"]): r["reason"] for r in result.collect()}
    assert told == {("popularity", "done", 1): None, ("popularity", "done", 10): None, ("broken", "failed", None): "RuntimeError: no"}
    assert [r["model"] for r in comparison.rank_models(result).collect()] == ["popularity"]
    weighed = comparison.trade_off(result).first()
    assert weighed["model"] == "popularity" and weighed["seconds"] > 0 and not weighed["dominated"]
    with pytest.raises(ValueError):
        comparison.compare_models(train, held, {}, [1])


def test_compared_models_run_side_by_side(spark):
    train = spark.createDataFrame([("u1", "a", 1), ("u1", "b", 2), ("u2", "a", 3)], "user_id string, item_id string, timestamp long")
    held, both = truth(spark, {"u1": ["a"], "u2": ["b"]}), threading.Barrier(2, timeout=60)

    def waits(train, users, k):
        both.wait()  # only passes while the other model is at it as well
        return simple.popularity(train, users, k)

    def broken(train, users, k):
        raise RuntimeError("no")

    alone = comparison.compare_models(train, held, {"x": simple.popularity, "y": simple.popularity}, [1, 2])
    result = comparison.compare_models(train, held, {"x": waits, "y": waits}, [1, 2], at_once=2)
    rows = lambda metrics: [r.asDict() for r in metrics.drop("seconds").collect()]
    assert rows(result) == rows(alone)
    with pytest.raises(RuntimeError, match="no"):
        comparison.compare_models(train, held, {"broken": broken, "x": simple.popularity}, [1], at_once=2)


def test_registered_comparison_keeps_the_driver_small(monkeypatch):
    """Four models at a time took 1,618 MB of a driver of 1,500, two 1,350."""
    told = []
    monkeypatch.setattr(models_catalog, "holdout", lambda *_: (None, None, None))
    monkeypatch.setattr(models_catalog.comparison, "compare_models", lambda *_, **options: told.append(options) or _Frame())
    monkeypatch.setattr(models_catalog.comparison, "harmonic_mean", lambda: None)
    monkeypatch.setattr(registry, "scale_to", lambda spark, _: spark)
    monkeypatch.setattr(registry, "configure", lambda spark: spark)
    registry.QUERIES["model_comparison"].plan(None, "")
    assert told == [{"at_once": 2}]


class _Frame:
    def drop(self, _):
        return self

    def withColumn(self, *_):
        return self


def test_batch_inference(spark):
    train = spark.createDataFrame([("u1", "a"), ("u2", "a"), ("u3", "b"), ("u1", "c")], "user_id string, item_id string")
    asked = spark.createDataFrame([("u1", 1), ("new", None)], "user_id string, limit int")
    rows = {r[0]: r[1] for r in comparison.batch_recommend(asked, lambda u, k: simple.popularity(train, u, k), 2).collect()}
    assert rows == {"u1": ["a"], "new": ["a", "b"]}
    renamed = asked.select(F.col("user_id").alias("visitor"))
    assert comparison.batch_recommend(renamed, lambda u, k: simple.popularity(train, u, k), 2).count() == 2


def test_list_lengths_are_data(hot):
    rows = [(f"u{u}", f"i{i:03}") for u in range(4) for i in range(0, 120, u + 1)]
    train = hot.createDataFrame(rows, "user_id string, item_id string")
    count = {}
    for _, i in rows:
        count[i] = count.get(i, 0) + 1
    order = sorted(count, key=lambda i: (-count[i], i))
    serve = lambda asked: comparison.batch_recommend(hot.createDataFrame(asked, "user_id string, limit int"), lambda w: simple.popularity_upto(train, w), limits_as_data=True)
    asked = [("u1", 3), ("u3", 50_000), ("new", None), ("u0", 5), ("u2", 0)]
    got = {r["user_id"]: r["recommendations"] for r in serve(asked).collect()}
    seen = {u: {i for x, i in rows if x == u} for u, _ in asked}
    for user, limit in asked:
        assert got[user] == [i for i in order if i not in seen[user]][: 10 if limit is None else limit]
    size = lambda frame: len(frame._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(serve(asked)) - size(serve([("u1", 3), ("u3", 7)]))) < 500
