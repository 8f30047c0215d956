"""Blocks of vectors, hashed candidates, and Ward's hierarchy against the sequential method."""

import random

import numpy as np
import pytest

from textloom.operators import vectors as V
from textloom.operators import ward

RNG = np.random.default_rng(4)


def table(spark, points, ids=None):
    ids = ids or list(range(len(points)))
    return spark.createDataFrame([(i, p.tolist() if p is not None else None) for i, p in zip(ids, points, strict=True)], f"id {'string' if isinstance(ids[0], str) else 'long'}, vector array<double>")


def clustered(n, dims, groups, spread):
    middles = RNG.standard_normal((groups, dims))
    return [middles[i % groups] + spread * RNG.standard_normal(dims) for i in range(n)]


def test_products_and_nearest_rows(spark):
    points = [*clustered(150, 8, 12, 0.3), np.zeros(8), None]
    rows = V.units(table(spark, points, [f"p{i:03}" for i in range(152)]))
    u = [p / np.linalg.norm(p) for p in points[:150]]
    want = {(f"p{i:03}", f"p{j:03}") for i in range(150) for j in range(i + 1, 150) if u[i] @ u[j] >= 0.9}
    found = [tuple(r) for r in V.product_pairs(rows, 0.9, size=40).collect()]
    assert len(found) == len(want) and set(found) == want
    targets = V.units(table(spark, points[:30]))
    near = {r.id: (r.target, r.cosine) for r in V.nearest(rows, targets, size=40).collect()}
    for i in range(150):
        best = min((-round(float(u[i] @ u[j]), 9), j) for j in range(30))
        assert near[f"p{i:03}"] == (best[1], pytest.approx(-best[0]))
    assert V.nearest(rows, targets.limit(0)).count() == 0


def test_hashed_candidates_are_few_and_find_most(spark):
    """10,000 vectors: fewer than a tenth of all pairs are compared, nine of ten near pairs are found."""
    points = clustered(10_000, 24, 4000, 0.28)
    rows = V.units(table(spark, points))
    u = np.array([p / np.linalg.norm(p) for p in points])
    candidates = V.hashed_candidates(rows, 0.8, recall=0.93, bits=11).count()
    assert candidates < 0.1 * 10_000 * 9_999 / 2
    i, j = np.nonzero(np.triu(u @ u.T >= 0.8, 1))
    want = set(zip(i.tolist(), j.tolist(), strict=True))
    found = {tuple(r) for r in V.hashed_pairs(rows, 0.8, recall=0.93, bits=11).collect()}
    assert found <= want and len(found) >= 0.9 * len(want) > 2000


def sequential(points):
    """Ward by the cheapest pair of all, again and again: the partition after each join."""
    clusters = {i: (1, p, {i}) for i, p in enumerate(points)}
    out = [[c[2] for c in clusters.values()]]
    while len(clusters) > 1:
        cost, i, j = min((a[0] * b[0] / (a[0] + b[0]) * float(((a[1] - b[1]) ** 2).sum()), i, j) for i, a in clusters.items() for j, b in clusters.items() if i < j)
        a, b = clusters[i], clusters.pop(j)
        clusters[i] = (a[0] + b[0], (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0]), a[2] | b[2])
        out.append([c[2] for c in clusters.values()])
    return out


@pytest.mark.parametrize(("n", "small"), [(70, 10), (70, 1), (60, 1024), (5, 1024), (1, 4)])
def test_levels_as_sequential_ward(spark, n, small):
    points = clustered(n, 3, 9, 0.6)
    want = {len(p): p for p in sequential(points)}
    rows = ward.levels(table(spark, [*points, None]), 18, small=small, size=20).collect()
    assert len(rows) == n
    for k in range(1, 19):
        found = {}
        for r in rows:
            found.setdefault(r[f"c{k}"], set()).add(r.id)
        assert all(c == min(xs) for c, xs in found.items())
        assert sorted(map(sorted, found.values())) == sorted(map(sorted, want[min(k, n)]))


def test_ward_of_ties_and_nothing(spark):
    points = [np.array([float(x), 0.0]) for x in [0, 0, 0, 1, 1, 5, 5, 5, 5]]
    for small in (1, 100):
        rows = {r.id: r for r in ward.levels(table(spark, points), 4, small=small, size=3).collect()}
        assert [rows[i].c2 for i in range(9)] == [0] * 5 + [5] * 4 and [rows[i].c3 for i in range(9)] == [0] * 3 + [3] * 2 + [5] * 4
    assert ward.levels(table(spark, points).limit(0)).count() == 0


def test_random_orders_give_one_hierarchy(spark):
    points = clustered(40, 2, 5, 0.5)
    order = list(range(40))
    random.Random(1).shuffle(order)
    a = ward.levels(table(spark, points), 6, small=8, size=10).collect()
    b = ward.levels(table(spark, [points[i] for i in order], order), 6, small=8, size=10).collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize(("scale", "offset", "sizes"), [(1, 0, 2), (1, 1000, 5), (1e-3, 1, 90), (1e20, 0, 5)])
def test_cheapest_of_both_sides_as_by_all_costs(scale, offset, sizes):
    """Also where single precision can't part the costs, with ties, limits and a side that meets itself."""

    def all_costs(a, n, b, m, most, own=None):
        cost = ward.costs(a, n, b, m)
        if own is not None:
            cost[np.arange(len(a)), own] = np.inf
        least = np.argsort(cost, axis=1, kind="stable")[:, :count]
        return [(i, int(j), cost[i, j], k == count - 1) for i in range(len(a)) for k, j in enumerate(least[i]) if cost[i, j] <= most[i] and cost[i, j] < np.inf]

    for rounded, count in ((False, 1), (True, 1), (False, 2), (True, 2)):
        a, b = (np.round(x) if rounded else x for x in (RNG.standard_normal((300, 6)), RNG.standard_normal((513, 6))))
        a, b = a * scale + offset, b * scale + offset
        n, m = RNG.integers(1, sizes, 300).astype(float), RNG.integers(1, sizes, 513).astype(float)
        most = np.where(RNG.random(300) < 0.5, np.inf, scale**2), np.where(RNG.random(513) < 0.5, -np.inf, scale**2)
        there, back = ward.cheapest(a, n, b, m, *most, count=count)
        assert list(zip(*there, strict=True)) == all_costs(a, n, b, m, most[0])
        assert list(zip(*back, strict=True)) == all_costs(b, m, a, n, most[1])
        alone, none = ward.cheapest(a, n, a, n, most[0], np.full(300, -np.inf), np.arange(300), count)
        assert list(zip(*alone, strict=True)) == all_costs(a, n, a, n, most[0], np.arange(300)) and not len(none[0])


def test_a_block_joins_as_one_by_one(monkeypatch):
    points = np.array(clustered(300, 5, 20, 0.7))
    sizes = RNG.integers(1, 4, 300)
    want = sorted((int(j), int(i), pytest.approx(c)) for j, i, c, _ in ward.last_joins(np.arange(300), sizes, points))
    monkeypatch.setattr(ward, "FEW", 3)
    found = ward.last_joins(np.arange(300), sizes, points)
    assert [(int(j), int(i), c) for j, i, c, _ in sorted(found, key=lambda x: (x[0], x[1]))] == want and len(found) == 299
    assert max(k for *_, k in found) < 100


def test_each_two_blocks_of_clusters_meet_once_in_a_round(spark, monkeypatch):
    made, met, plain_blocks, plain_pairs = [], [], ward.in_blocks, ward.by_blocks
    monkeypatch.setattr(ward, "in_blocks", lambda *args: made.append(1) or plain_blocks(*args))
    monkeypatch.setattr(ward, "by_blocks", lambda *args, **more: met.append(more.get("twice", True)) or plain_pairs(*args, **more))
    joins = ward.joins(table(spark, clustered(60, 3, 9, 0.6)), small=20, size=10)
    assert joins.count() == 59 and made and len(made) == len(met) and not any(met)
