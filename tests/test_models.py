"""Recommenders against the fixtures and against dense numpy solutions."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trailmark.models import conjugate, ease, latent, logistic, neighbours, neural, pairwise, simple
from trailmark.models.blocked import fold_scores, from_bytes, multiply_rows
from trailmark.operators import ranking_metrics
from trailmark.operators.cooccurrence import cooccurrence
from trailmark.storage import LARGE_ROWS, materialise

CATALOGUE = [f"p{i}" for i in range(7)]
_draws = np.random.default_rng(21)
PAIRS = sorted({(f"v{u}", CATALOGUE[int(i)]) for u in range(5) for i in _draws.integers(0, 7, 6)})


def unseen(user):
    return {i for _, i in PAIRS} - {i for u, i in PAIRS if u == user}


@pytest.fixture
def train(spark):
    return spark.createDataFrame(PAIRS, "user_id string, item_id string")


def users(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "user_id string")


def as_dict(recommendations):
    result = {}
    for r in recommendations.orderBy("user_id", "rank").collect():
        result.setdefault(r["user_id"], []).append(r["item_id"])
    return result


def test_simple_models(spark):
    rng = np.random.default_rng(22)
    rows = [(f"v{rng.integers(40)}", CATALOGUE[int(i)], t) for t, i in enumerate(rng.choice(7, 60, p=[0.3, 0.22, 0.16, 0.12, 0.1, 0.06, 0.04]))]
    frame = spark.createDataFrame(rows, "user_id string, item_id string, timestamp long")
    counts, latest = {}, {}
    for _, i, t in rows:
        counts[i], latest[i] = counts.get(i, 0) + 1, t
    assert as_dict(simple.popularity(frame, users(spark, "x"), 10)) == {"x": sorted(counts, key=lambda i: (-counts[i], i))}
    assert as_dict(simple.recent_items(frame, users(spark, "x"), 3)) == {"x": sorted(latest, key=lambda i: -latest[i])[:3]}
    with pytest.raises(ValueError):
        simple.popularity(frame, users(spark, "x"), 0)


@pytest.mark.parametrize("items", [4, 200])
def test_random_lists(spark, items):
    catalogue = spark.range(items).select(F.lit("u").alias("user_id"), F.concat(F.lit("i"), "id").alias("item_id"))
    first = as_dict(simple.random_items(catalogue, users(spark, "a", "b"), 3))
    assert first == as_dict(simple.random_items(catalogue.repartition(3), users(spark, "b", "a"), 3))
    assert all(len(set(v)) == 3 for v in first.values())
    assert as_dict(simple.random_items(catalogue, users(spark, "a"), 3, seed=1)) != {"a": first["a"]} or items == 4
    assert all(len(set(v)) == min(items, 9) for v in as_dict(simple.random_items(catalogue, users(spark, "a", "b"), 9)).values())


def test_unseen_prefix_matches_brute_force(hot):
    rng = np.random.default_rng(0)
    pairs = {(f"u{u}", f"i{int(i):02}") for u in range(6) for i in rng.integers(0, 40, size=[0, 3, 20, 39, 60, 8][u])}
    frame = hot.createDataFrame(sorted(pairs), "user_id string, item_id string").withColumn("weight", F.lit(1.0))
    counts = {}
    for _, i in pairs:
        counts[i] = counts.get(i, 0) + 1
    order = sorted(counts, key=lambda i: (-counts[i], i))
    got = as_dict(simple.popularity(frame, users(hot, *(f"u{u}" for u in range(6))), 12, exclude_seen=True))
    for u in range(6):
        expected = [i for i in order if (f"u{u}", i) not in pairs][:12]
        assert got.get(f"u{u}", []) == expected
    padded = as_dict(simple.most_popular(frame, users(hot, "u4", "u0"), 12))
    free = [i for i in order if ("u4", i) not in pairs][:12]
    assert padded["u4"] == free + order[: 12 - len(free)] and padded["u0"] == order[:12]


MODELS = {
    "knn": lambda t, u, k: neighbours.item_knn(t, u, k),
    "knn_weighted": lambda t, u, k: neighbours.item_knn_weighted(t.withColumn("weight", F.lit(1.0)), u, k),
    "logistic": lambda t, u, k: logistic.logistic_regression(t, u, k),
    "ease": lambda t, u, k: ease.ease(t, u, k, block=2),
    "ease_conjugate": lambda t, u, k: ease.ease(t, u, k, block=2, solver="conjugate"),
}


@pytest.mark.parametrize("name", MODELS)
def test_personal_models_leave_out_seen_items(spark, train, name):
    got = as_dict(MODELS[name](train, users(spark, "v1", "v2", "nobody"), 3))
    for user in ("v1", "v2"):
        assert len(got[user]) == min(3, len(unseen(user))) and set(got[user]) <= unseen(user)
    assert len(got["nobody"]) == 3


@pytest.mark.parametrize("group", [1000, 3])
def test_cooccurrence_blocks(spark, group):
    rng = np.random.default_rng(1)
    matrix = (rng.random((12, 30)) < 0.4) * rng.integers(1, 5, (12, 30))
    matrix[0] = 1
    rows = [(int(u), int(i), float(matrix[u, i])) for u, i in zip(*np.nonzero(matrix))]
    frame = spark.createDataFrame(rows, "u long, i long, w double")
    got = {(r["item_i"], r["item_j"]): r["dot"] for r in cooccurrence(frame, "u", "i", "w", group).collect()}
    gram = matrix.T @ matrix
    expected = {(i, j): float(gram[i, j]) for i in range(30) for j in range(i + 1, 30) if gram[i, j]}
    assert got == expected


def test_conjugate_lists_need_no_stored_panels(spark, monkeypatch):
    """Panels are solved and scored in tasks that hold the interactions: nothing of the size of the inverse is stored or exchanged."""
    rng = np.random.default_rng(12)
    matrix = (rng.random((50, 30)) < 0.2).astype(float)
    pairs = [(f"u{u:02}", f"i{j:02}") for u, j in zip(*np.nonzero(matrix))] + [(None, "i03"), (None, "i07")]
    frame = spark.createDataFrame(pairs, "user_id string, item_id string")
    asked = users(spark, *(f"u{u:02}" for u in range(0, 50, 3)), "nobody")
    ready = lambda solver: sorted((r["user_id"], r["rank"], r["item_id"], round(r["score"], 7)) for r in ease.ease(frame, asked, 7, 5.0, popularity_weight=0.1, solver=solver).collect())
    expected = ready("dense")

    def stored(*_, **__):
        raise AssertionError("panels were stored")

    monkeypatch.setattr(conjugate, "solve_panels", stored)
    monkeypatch.setattr(ease, "TASK_BYTES", 8 * (4 * 30 + 2 * 52) * 4)  # panels of four columns
    monkeypatch.setattr(ease, "PART_USERS", 16)
    assert ready("conjugate") == expected
    monkeypatch.setattr(ease, "TASK_ENTRIES", 10)
    with pytest.raises(AssertionError):  # more than a task may hold: in stored blocks as before
        ready("conjugate")


def test_places_multiply_as_their_matrix(monkeypatch):
    monkeypatch.setattr(conjugate, "SLOT_ROWS", 4)
    rng = np.random.default_rng(13)
    matrix = (rng.random((23, 17)) < rng.random((23, 1))).astype(float)
    matrix[[0, 5]] = 0
    starts, columns = np.concatenate([[0], np.cumsum(matrix.sum(1).astype(int))]), np.nonzero(matrix)[1].astype(np.int32)
    dense = rng.random((17, 3))
    across = conjugate.Places(starts, columns)
    assert np.allclose(across.times(dense, np.empty((23, 3))), matrix @ dense)
    down = conjugate.Places(*conjugate.transposed(starts, columns, 17))
    assert np.allclose(down.times(dense[np.arange(23) % 17], np.empty((17, 3))), matrix.T @ dense[np.arange(23) % 17])
    inverse = np.linalg.inv(matrix.T @ matrix + 2 * np.eye(17))
    assert np.allclose(conjugate.solve_columns(across, down, matrix.sum(0) + 2, 2.0, range(3, 9)), inverse[:, 3:9], atol=1e-10)


def test_best_lists_keep_the_smaller_of_equal_columns():
    rng = np.random.default_rng(14)
    scores = rng.integers(0, 6, (9, 40)).astype(float)
    scores[rng.random(scores.shape) < 0.2] = -np.inf
    scores[4, 3:] = -np.inf
    lists = ease.BestLists(9, 5)
    for first in range(0, 40, 7):
        lists.add(scores[:, first : first + 7], first)
    got = list(zip(*(c.tolist() for c in lists.ended())))
    assert got == [(u, i, scores[u, i]) for u in range(9) for i in sorted(range(40), key=lambda i: (-scores[u, i], i))[:5] if np.isfinite(scores[u, i])]


@pytest.mark.parametrize("regularisation,block,solver", [(250.0, 512, "dense"), (1.0, 5, "dense"), (250.0, 512, "conjugate"), (20.0, 5, "conjugate")])
def test_ease_matches_dense_inverse(spark, monkeypatch, regularisation, block, solver):
    monkeypatch.setattr(conjugate, "ROWS", block - 1)
    rng = np.random.default_rng(2)
    matrix = (rng.random((40, 12)) < 0.3).astype(float)
    matrix[0] = 0
    matrix[0, 3] = 1
    names = [f"i{j:02}" for j in range(12)]
    rows = [(f"u{u:02}", names[j]) for u, j in zip(*np.nonzero(matrix))]
    frame = spark.createDataFrame(rows, "user_id string, item_id string")
    model = ease.fit_ease(frame, regularisation, 0, block, solver, columns_at_once=2 * block)
    inverse = np.linalg.inv(matrix.T @ matrix + regularisation * np.eye(12))
    expected = -inverse / np.diag(inverse)
    np.fill_diagonal(expected, 0.0)
    got, groups = np.zeros((12, 12)), 0
    for columns, weights in model.groups():
        groups += 1
        for r in weights.collect():
            assert r["bj"] in columns
            data = from_bytes(r["data"], model.width)
            i, j = r["bi"] * model.rows, r["bj"] * model.width
            got[i : i + model.rows, j : j + model.width] = data[: 12 - i, : 12 - j]
    assert groups == (2 if (block, solver) == (5, "conjugate") else 1)
    assert np.abs(got - expected).max() < 1e-8 and np.abs(np.diag(got)).max() == 0
    for weight in (0.0, 0.5) if groups == 1 else (0.5,):
        scores = matrix @ expected + weight * np.log1p(matrix.sum(0))
        scores[matrix > 0] = -np.inf
        lists = as_dict(ease.recommend_ease(model, users(spark, "u00", "u07"), 4, weight, users_per_shard=1))
        for u in (0, 7):
            order = np.argsort(-np.round(scores[u], 10), kind="stable")
            assert lists[f"u{u:02}"] == [names[j] for j in order if np.isfinite(scores[u, j])][:4]


def test_panels_are_made_and_stored_a_few_rows_at_a_time(spark, monkeypatch):
    entries, made = spark.createDataFrame([(i, i, 300.0) for i in range(40)], "i long, j long, w double"), []
    blocks = conjugate.compress(entries, 40, 2)
    map_in_pandas = type(entries).mapInPandas
    monkeypatch.setattr(type(entries), "mapInPandas", lambda self, run, schema: made.append(run) or map_in_pandas(self, run, schema))
    panels = materialise(conjugate.unit_panels(blocks, 0, 2, 20).coalesce(1), "panels", large=True)
    batch = pd.DataFrame({"panel": [0, 1, 1], "block": [0, 1, 2], "scale": [np.ones(2).tobytes()] * 3})
    assert [len(frame) for frame in made[0](iter([batch]))] == [1, 1, 1]
    files = [f.removeprefix("file:") for f in panels.inputFiles()]
    stored = [pq.ParquetFile(f).metadata for f in files]
    assert sum(m.num_rows for m in stored) == 40
    assert max(m.row_group(g).num_rows for m in stored for g in range(m.num_row_groups)) <= LARGE_ROWS


def test_conjugate_columns(spark, monkeypatch):
    monkeypatch.setattr(conjugate, "FAN", 2)
    rng = np.random.default_rng(8)
    n = 24
    factor = (rng.random((60, n)) < 0.15) * rng.integers(1, 4, (60, n))
    matrix = factor.T @ factor + 15.0 * np.eye(n)
    rows = [(int(i), int(j), float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix))]
    rows += [(3, 3, 1.0), (4, 7, 0.25), (7, 4, 0.25)]  # entries of one place are added
    matrix[3, 3] += 1
    matrix[[4, 7], [7, 4]] += 0.25
    entries = spark.createDataFrame(rows, "i long, j long, w double").repartition(5)
    inverse = np.linalg.inv(matrix)
    for size, width in ((7, 5), (n, 5)):
        blocks = conjugate.compress(entries, n, size)
        solved, done = conjugate.solve_panels(blocks, 2, 2, width)
        got = {(r["i"], r["j"]): r["value"] for r in conjugate.entries_of(solved, n, size, width).collect()}
        assert set(got) == {(i, j) for i in range(n) for j in range(2 * width, 4 * width)}
        assert max(abs(v - inverse[i, j]) for (i, j), v in got.items()) < 1e-9
        assert done < 2 * n
        rest = solved.select("residual").collect()
        assert max(np.abs(np.frombuffer(r["residual"])).max() for r in rest) < 1e-10
    with pytest.raises(RuntimeError, match="conjugate"):
        conjugate.solve_panels(conjugate.compress(entries, n, 7), 0, 1, 5, rounds=1)


def test_multiplied_rows_match_dense():
    rng = np.random.default_rng(9)
    for share in (0.0, 0.02, 0.1, 0.6):
        matrix = (rng.random((50, 40)) < share) * rng.normal(size=(50, 40))
        starts = np.append(0, np.cumsum((matrix != 0).sum(1)))
        rows, columns = np.nonzero(matrix)
        dense = rng.normal(size=(40, 6))
        assert np.allclose(multiply_rows(starts, columns, matrix[rows, columns], dense, slab=24), matrix @ dense)


@pytest.mark.parametrize("n", [400, 4000])
def test_scoring_holds_the_same_for_any_catalogue(n):
    rng, size, width, k = np.random.default_rng(10), 50, 20, 5
    histories = [np.unique(rng.integers(0, n, 60)) for _ in range(30)]
    weights = rng.normal(size=(n, width))
    columns = ["shard", "bj", "bi", "kind", "number", "i", "data"]
    schema = pa.schema([*((c, pa.int64()) for c in columns[:-1]), ("data", pa.binary())])
    stream = [(0, 3, -1, 1, 0, 0, np.full(width, 0.5).tobytes())]
    for block in range(n // size):
        stream += [(0, 3, block, 0, u, int(i), None) for u, own in enumerate(histories) for i in own if i // size == block]
        stream.append((0, 3, block, 1, 0, 0, weights[block * size : (block + 1) * size].tobytes()))
    batches = [pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*stream[at : at + 37]), schema)], schema=schema) for at in range(0, len(stream), 37)]
    held = []
    found = pa.Table.from_batches(fold_scores(iter(batches), width, size, n, k, held.append)).to_pylist()
    scores = np.stack([weights[own].sum(0) for own in histories]) + 0.5
    for u, own in enumerate(histories):
        for i in own[(own >= 3 * width) & (own < 4 * width)]:
            scores[u, i - 3 * width] = -np.inf
        best = np.argsort(-scores[u], kind="stable")[:k] + 3 * width
        assert [r["item"] for r in found if r["number"] == u] == best.tolist()
    sums, block = 2 * 30 * width * 8, size * width * 8  # whatever n is
    assert max(held) <= sums + block + 30 * 60 * 16


def test_ease_catalogue_limit(spark):
    counts = dict(zip(CATALOGUE, (2, 6, 1, 5, 1, 7, 2)))
    pairs = [(f"v{n}", i) for i, c in counts.items() for n in range(c)]
    frame = spark.createDataFrame(pairs, "user_id string, item_id string")
    model = ease.fit_ease(frame, max_items=3)
    assert sorted(r["id"] for r in model.items.collect()) == sorted(sorted(counts, key=lambda i: -counts[i])[:3])
    assert ease.fit_ease(frame).n == len(counts)
    with pytest.raises(ValueError):
        ease.fit_ease(frame, regularisation=0)


def test_logistic_reaches_the_optimum(spark):
    rng = np.random.default_rng(4)
    rows = [(f"u{rng.integers(12)}", f"i{rng.integers(9)}", int(rng.integers(2)), 1.0) for _ in range(300)]
    frame = spark.createDataFrame(rows, "user_id string, item_id string, label int, n double")
    model = logistic.fit_logistic(frame)
    wu = {r["user_id"]: r["w_user"] for r in model.users.collect()}
    wi = {r["item_id"]: r["w_item"] for r in model.items.collect()}
    slope = {k: w for k, w in (*wu.items(), *wi.items())}
    total = model.intercept
    for u, i, label, n in rows:
        g = n * (1 / (1 + np.exp(-(model.intercept + wu[u] + wi[i]))) - label)
        slope[u] += g
        slope[i] += g
        total += g
    assert max(map(abs, slope.values())) < 1e-3 and abs(total) < 1e-3


def test_latent_and_rerank(spark, train):
    weights = train.withColumn("weight", F.lit(1.0))
    model = latent.fit_latent(weights, rank=4, iterations=3)
    got = as_dict(latent.recommend_latent(model, users(spark, "v1", "v2", "nobody"), 2, block=2, users_per_shard=1))
    factors = {r["item_id"]: np.array(r["factors"]) for r in model.item_factors.collect()}
    own = {r["user_id"]: np.array(r["factors"]) for r in model.user_factors.collect()}
    for user in ("v1", "v2"):
        assert got[user] == sorted(unseen(user), key=lambda i: -float(own[user] @ factors[i]))[:2]
    assert set(got) == {"v1", "v2"}
    again = as_dict(latent.neural_rerank(train, weights, users(spark, "v1", "v2"), 7, rank=4, iterations=3, layers=(4,)))
    assert {u: set(v) for u, v in again.items()} == {u: unseen(u) for u in ("v1", "v2")}


def test_network_scores_are_those_of_the_fitted_model(spark, train):
    model = latent.fit_latent(train.withColumn("weight", F.lit(1.0)), rank=3, iterations=2)
    network = latent.fit_reranker(model, train, layers=(5, 4), iterations=4)
    pairs = model.user_factors.select("user_id").crossJoin(model.item_factors.select("item_id"))
    scored = network.transform(latent._interaction_features(pairs, model)).collect()
    own = {r["user_id"]: np.array(r["factors"]) for r in model.user_factors.collect()}
    items = {r["item_id"]: np.array(r["factors"]) for r in model.item_factors.collect()}
    score = latent.network_scorer(network, [9, 5, 4, 2])
    for r in scored:
        assert abs(score(own[r.user_id][None], items[r.item_id][None])[0, 0] - r.probability[1]) < 1e-8


def grouped_pairs(spark):
    """Users and items of three groups; users like items of their own group, the first item of each more than the rest."""
    rng = np.random.default_rng(30)
    pairs = {(f"u{u:02}", f"i{(g := u % 3)}{n:02}") for u in range(60) for n in rng.choice(20, 8, replace=False, p=np.arange(20, 0, -1) / 210)}
    pairs |= {(f"u{u:02}", f"i{int(rng.integers(3))}{int(rng.integers(20)):02}") for u in range(60)}
    return pairs, spark.createDataFrame(sorted(pairs), "user_id string, item_id string")


@pytest.mark.parametrize("blocks", [1, 3])
def test_pairwise_ranks_own_group_first(spark, blocks):
    pairs, frame = grouped_pairs(spark)
    model = pairwise.fit_pairwise(frame, rank=6, epochs=10, blocks=blocks)
    lists = as_dict(latent.recommend_latent(model, users(spark, "u00", "u01", "u02", "u30", "nobody"), 5, block=7, users_per_shard=2))
    assert "nobody" not in lists
    own = [(u, i) for u, items in lists.items() for i in items]
    assert len(own) == 20 and not set(own) & pairs
    assert sum(int(i[1]) == int(u[1:]) % 3 for u, i in own) >= 16
    rng = np.random.default_rng(31)
    catalogue = sorted({i for _, i in pairs})
    triplets = [(u, i, j) for u, i in sorted(pairs) for j in rng.choice(catalogue, 3) if (u, j) not in pairs]
    table = spark.createDataFrame(triplets, "user_id string, positive string, negative string")
    loss = pairwise.pairwise_loss(model, table)
    assert loss < 0.4
    if blocks == 1:
        assert pairwise.pairwise_loss(latent.fit_latent(frame.withColumn("weight", F.lit(1.0)), rank=6), table) > 0.4
        return
    again = pairwise.fit_pairwise(frame.repartition(7).orderBy(F.desc("item_id")), rank=6, epochs=10, blocks=blocks)
    values = lambda m: {r["user_id"]: r["factors"] for r in m.user_factors.collect()}
    assert values(model) == values(again)


def test_pairwise_step_lowers_the_loss_of_its_cell():
    rng = np.random.default_rng(32)
    of_user, of_item = np.nonzero(rng.random((20, 15)) < 0.3)
    users_, items_ = rng.normal(0, 0.1, (20, 5)), rng.normal(0, 0.1, (15, 5))
    users_[:, -1] = 1.0
    unseen = [(u, i, j) for u, i in zip(of_user, of_item) for j in range(15) if j not in of_item[of_user == u]]
    loss = lambda: np.mean([np.log1p(np.exp(-users_[u] @ (items_[i] - items_[j]))) for u, i, j in unseen])
    squares = np.zeros_like(users_), np.zeros_like(items_)
    before = loss()
    for turn in range(30):
        pairwise.descend(users_, squares[0], items_, squares[1], (of_user, of_item), np.random.default_rng(turn), 0.1, 0.0)
    assert loss() < 0.5 * before and (users_[:, -1] == 1).all()
    full = np.nonzero(np.ones((2, 3)))  # users who have seen the whole block
    pairwise.descend(users_[:2], squares[0][:2], items_[:3], squares[1][:3], full, rng, 0.1, 0.0)


def test_network_slopes_are_numerical_slopes():
    rng = np.random.default_rng(40)
    rank, layers = 3, (5, 4)
    flat = neural.first_network(rank, layers, 1) + rng.normal(0, 0.1, sum(int(np.prod(s)) for s in neural.shapes(rank, layers)))
    own, items, labels = rng.normal(size=(7, 6)), rng.normal(size=(7, 6)), rng.integers(0, 2, 7).astype(float)
    loss, *slopes = neural.losses(flat, rank, layers, own, items, labels)
    for place, slope in zip((flat, own, items), slopes):
        for at in rng.choice(place.size, min(40, place.size), replace=False):
            cell = np.unravel_index(at, place.shape)
            kept = place[cell]
            ends = []
            for step in (1e-6, -1e-6):
                place[cell] = kept + step
                ends.append(neural.losses(flat, rank, layers, own, items, labels)[0])
            place[cell] = kept
            assert abs((ends[0] - ends[1]) / 2e-6 - slope[cell]) < 1e-5
    scores = neural.pair_scores(flat, rank, layers)(own, items)
    told = [neural.losses(flat, rank, layers, own[[u]], items[[i]], np.zeros(1))[0] for u, i in ((0, 1), (3, 3), (6, 2))]
    assert np.allclose([-np.log(1 - scores[u, i]) for u, i in ((0, 1), (3, 3), (6, 2))], told, atol=1e-6)


@pytest.mark.parametrize("blocks", [1, 2])
def test_neural_model_tells_groups_apart(spark, blocks):
    pairs, frame = grouped_pairs(spark)
    model = neural.fit_neural(frame, rank=4, layers=(8, 4), epochs=8, blocks=blocks)
    catalogue, everyone = sorted({i for _, i in pairs}), sorted({u for u, _ in pairs})
    unknown = [(u, i, int(i[1] == str(int(u[1:]) % 3))) for u in everyone for i in catalogue if (u, i) not in pairs]
    held = spark.createDataFrame(unknown, "user_id string, item_id string, label int")
    area = ranking_metrics.auc(neural.score_pairs(model, held).select("score", "label"), digits=6).first()[0]
    assert area > 0.85
    lists = as_dict(neural.recommend_neural(model, users(spark, "u00", "u30", "nobody"), 5, block=7))
    assert set(lists) == {"u00", "u30"} and not {(u, i) for u, items in lists.items() for i in items} & pairs
    if blocks > 1:
        again = neural.fit_neural(frame.repartition(5), rank=4, layers=(8, 4), epochs=8, blocks=blocks)
        assert (again.network == model.network).all()


def test_recommenders_score_the_catalogue_and_no_padding(spark, train):
    """The last block ends with the last item: the scorer of a catalogue of 7 gets 7 item vectors, of blocks of 4 it gets 4 and 3."""
    model = latent.fit_latent(train.selectExpr("*", "1e0 AS weight"), rank=4, iterations=1)
    told = lambda own, items: np.full((len(own), len(items)), float(len(items)))
    for block, sizes in ((512, {7.0}), (4, {4.0, 3.0})):
        rows = latent._recommend(model, users(spark, "v1", "v2"), 7, told, block, 100).collect()
        assert {r.score for r in rows} == sizes and all(len({r.item_id for r in rows if r.user_id == u}) == len(unseen(u)) for u in ("v1", "v2"))


def test_networks_score_pairs_together_as_one_by_one(monkeypatch):
    rng, layers = np.random.default_rng(4), (6, 5)
    own, items = rng.normal(0, 1, (9, 6)), rng.normal(0, 1, (7, 6))
    sizes = [18, *layers, 2]

    class Network:
        weights = type("Weights", (), {"toArray": staticmethod(lambda: np.random.default_rng(5).normal(0, 1, sum((a + 1) * b for a, b in zip(sizes, sizes[1:]))))})

    scorers = lambda: (latent.network_scorer(Network, sizes), neural.pair_scores(neural.first_network(3, layers, 1), 3, layers))
    for number, score in enumerate(scorers()):
        whole = score(own, items)
        single = np.vstack([np.hstack([score(own[[u]], items[[i]]) for i in range(7)]) for u in range(9)])
        assert whole.shape == (9, 7) and np.allclose(whole, single, atol=2e-9)
        for most in (1, 20):
            monkeypatch.setattr(latent, "PAIRS_AT_ONCE", most)
            monkeypatch.setattr(neural, "PAIRS_AT_ONCE", most)
            assert np.allclose(scorers()[number](own, items), whole, atol=2e-9)
        assert score(own[:0], items).shape == (0, 7)


def test_moved_blocks_of_a_cell_are_passed_on_before_the_next_is_moved():
    moved = []
    move = lambda r: moved.append(r.ub) or [("user", r.ub, b"", b""), ("item", r.ib, b"", b"")]
    passed = pairwise.by_cell(iter([pd.DataFrame({"ub": [0, 1, 2], "ib": [1, 2, 0]})]), move)
    assert list(next(passed)["block"]) == [0, 1] and moved == [0]
    assert sum(len(rows) for rows in passed) == 4 and moved == [0, 1, 2]
