"""Neighbour descent against exact neighbours, and how many of them a layout keeps."""

import numpy as np

from textloom.operators import layout as L

RNG = np.random.default_rng(8)


def points(n, dims, groups, spread):
    middles = RNG.standard_normal((groups, dims))
    p = np.array([middles[i % groups] + spread * RNG.standard_normal(dims) for i in range(n)])
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def table(spark, p):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)] + [(-1, None), (-2, [0.0] * p.shape[1])], "id long, vector array<double>")


def exact(p, k):
    near = p @ p.T
    np.fill_diagonal(near, -9)
    return {i: set(np.argsort(-near[i], kind="stable")[:k].tolist()) for i in range(len(p))}


def kept(places, want, k):
    """The share of neighbours that are among the nearest in the plane too."""
    ids = sorted(places)
    xy = np.array([places[i] for i in ids])
    d = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, 9e9)
    return np.mean([len({ids[j] for j in np.argsort(d[r])[:k]} & want[i]) / k for r, i in enumerate(ids)])


def test_descent_finds_nine_of_ten_and_the_layout_keeps_more_than_components(spark):
    k, p = 10, points(400, 24, 16, 0.35)
    want = exact(p, k)
    rows = table(spark, p)
    graph = L.neighbours(rows, k).collect()
    found = {}
    for r in graph:
        found.setdefault(r.x, set()).add(r.y)
    recall = np.mean([len(found[i] & want[i]) / k for i in want])
    assert set(found) == set(want) and all(len(x) == k for x in found.values()) and recall >= 0.9
    known = spark.createDataFrame([tuple(r) for r in graph], "x long, y long, near double")
    before = {r.id: (r.p, r.q) for r in L.start(rows).collect()}
    after = {r.id: (r.p, r.q) for r in L.layout(rows, k, rounds=20, graph=known).collect()}
    assert set(after) == set(want) and all(np.isfinite(v).all() for v in map(np.array, after.values()))
    assert kept(after, want, k) > kept(before, want, k) + 0.04  # 0.48 and 0.42


def test_few_rows(spark):
    p = points(3, 4, 1, 1.0)
    assert L.layout(table(spark, p), 5, rounds=2).count() == 3
    assert L.layout(table(spark, p).filter("id < 0"), 5, rounds=2).count() == 0
