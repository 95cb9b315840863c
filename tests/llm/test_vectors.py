"""Vector codes and zone clusters against plain loops over Python integers."""

import hashlib
import itertools
import math

import numpy as np
import pytest

from trailmark.llm import vector_codes, zone_clusters
from trailmark.llm.vectors import squared_distances

ROWS = "vec_id long, embedding array<double>, label int, id string, v int, cluster int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", 1, 2) for i, v, label in rows], ROWS).repartition(4)


def whole(v, scale):
    return [max(-(1 << 26), min(1 << 26, math.floor(scale * x))) for x in v]


def away(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def moved(points, members):
    return [[sum(c) // len(m) for c in zip(*m)] if m else p for p, m in zip(points, members)]


def nearest(v, points):
    return min(range(len(points)), key=lambda k: (away(v, points[k]), k))


def brute_clusters(rows, dims, k, rounds):
    kept = [(i, whole(v, 64)) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    points = [v for _, v in first]
    for _ in range(rounds):
        members = [[] for _ in points]
        for _, v in kept:
            members[nearest(v, points)].append(v)
        points = moved(points, members)
    told = [(i, nearest(v, points), away(v, points[nearest(v, points)])) for i, v in kept]
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return [(i, c, d, sum(x for _, b, x in told if b == c), sum(x for *_, x in told), digest[c]) for i, c, d in told]


def brute_codes(rows, dims, parts, entries, rounds):
    kept = [(i, whole(v, 4096), label) for i, v, label in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    width = dims // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for _, v, _ in kept:
                members[nearest(cut(v, p), books[p])].append(cut(v, p))
            books[p] = moved(books[p], members)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    told = []
    for i, v, label in kept:
        code = [nearest(cut(v, p), books[p]) for p in range(parts)]
        told.append((i, "".join(f"{c:02x}" for c in code), sum(away(cut(v, p), books[p][c]) for p, c in enumerate(code)), label))
    return [(i, c, e, sum(x for *_, x, b in told if b == label), digest) for i, c, e, label in told]


def some_rows(dims, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, dims))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.15, dims)).tolist(), i % 4 or None) for i in range(240)]
    same = [0.25] * dims  # a third of all rows are one vector
    rows += [(1000 + i, same, 7) for i in range(120)] + [(3, rows[3][1], 1), (3, rows[3][1], 1), (None, rows[9][1], None), (None, same, 2)]
    # quarters tie often
    rows += [(2000 + i, rng.integers(-2, 3, dims).astype(float) / 4, None) for i in range(40)]
    odd = [None, [], [1.0] * (dims - 1), [None] + [0.0] * (dims - 1), [float("nan")] + [0.0] * (dims - 1), [float("inf")] + [0.0] * (dims - 1), [-1e300] + [0.5] * (dims - 1)]
    return [(i, None if v is None else list(v), label) for i, v, label in rows] + [(5000 + i, v, 1) for i, v in enumerate(odd)]


def key(row):
    return [(x is None, x if x is not None else 0) for x in row]


@pytest.mark.parametrize("block", [7, 256])
def test_clusters_match_brute_force(spark, block):
    rows = some_rows(8)
    got = zone_clusters.cluster(frame(spark, rows), dims=8, centroids=9, block=block)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_clusters(rows, 8, 9, 3), key=key)


def test_clusters_of_few_rows(spark):
    assert zone_clusters.cluster(frame(spark, []), dims=4).count() == 0
    rows = [(1, [0.5, 0.1, 0, 1], None), (2, [0.5, 0.1, 0, 1], 3), (4, [0, 0, 0, 0], 3), (5, None, 1)]
    got = zone_clusters.cluster(frame(spark, rows), dims=4)
    assert sorted(map(tuple, got.collect())) == sorted(brute_clusters(rows, 4, 16, 3))


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = [k.tobytes() for k in zone_clusters.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        walk = cells[np.argsort(np.array(keys, object), kind="stable")]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_boxes_exclude_only_what_cannot_win():
    rng = np.random.default_rng(2)
    fewer = 0
    for _ in range(200):
        points = rng.integers(-50, 50, (12, 3))
        block = rng.integers(-50, 50, 3) + rng.integers(-6, 7, (20, 3))
        near = zone_clusters.candidates(block.min(0), block.max(0), points)
        exact = squared_distances(block, points)
        assert set(exact.argmin(1)) <= set(near) and set(np.nonzero(exact == exact.min(1)[:, None])[1]) <= set(near)
        fewer += len(near) < 6
    assert fewer > 150
    far = np.array([[0, 0], [1 << 26, -(1 << 26)]])
    assert squared_distances(far, far)[0, 1] == 2 << 52


def test_tree_finds_the_lowest_of_the_nearest():
    rng = np.random.default_rng(3)
    saved = 0
    for n, spread in ((1, 5), (4, 5), (16, 3), (16, 2000), (200, 4000), (16, 1 << 26)):
        entries = rng.integers(-spread, spread, (n, 4))
        entries[n // 2] = entries[0]
        queries = np.concatenate([rng.integers(-spread, spread, (300, 4)), entries, entries[rng.integers(0, n, 300)] + rng.integers(-1, 2, (300, 4))])
        number, squares, computed = vector_codes.nearest_entries(vector_codes.build(entries), entries, queries)
        exact = np.array([[away(q, e) for e in entries.tolist()] for q in queries.tolist()], dtype=object)
        assert (number == [min(range(n), key=lambda k: (row[k], k)) for row in exact]).all()
        assert (squares == exact.min(1)).all()
        saved += computed < 0.6 * exact.size
    assert saved >= 1
    centres = rng.integers(-5000, 5000, (8, 4))
    entries, queries = (centres[rng.integers(0, 8, n)] + rng.integers(-40, 40, (n, 4)) for n in (64, 500))
    number, squares, computed = vector_codes.nearest_entries(vector_codes.build(entries), entries, queries)
    assert (squares == squared_distances(queries, entries).min(1)).all() and (number == squared_distances(queries, entries).argmin(1)).all()
    assert computed < 0.4 * 64 * 500
    none = vector_codes.nearest_entries(vector_codes.build(entries), entries, queries[:0])
    assert len(none[0]) == 0 and none[2] == 0


def test_codes_match_brute_force(spark):
    rows = some_rows(8, seed=6)
    got = vector_codes.compress(frame(spark, rows), parts=4, entries=16, rounds=6)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_codes(rows, 8, 4, 16, 6), key=key)


def test_codes_of_few_rows(spark):
    assert vector_codes.compress(frame(spark, [])).count() == 0
    assert vector_codes.compress(frame(spark, [(1, None, 1), (2, [1.0] * 7, 1)])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [(1, [0.5] * 8, None), (2, [0.1] * 8, 3), (2, [0.1] * 8, 3), (None, [0.0] * 8, 3)]
    got = vector_codes.compress(frame(spark, rows), parts=2, entries=3, rounds=2)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_codes(rows, 8, 2, 3, 2), key=key)
    with pytest.raises(ValueError):
        vector_codes.compress(frame(spark, rows), entries=257)
