import random
from collections import defaultdict

import pytest

from textloom.operators import time_joins as J


def times(rng, n):
    return [rng.choice([rng.randrange(40), rng.uniform(0, 400)]) * 1.0 for _ in range(n)]


@pytest.mark.parametrize("groups", [["hot"], ["a", "b", "c", None]])
def test_dominant_labels(spark, groups):
    rng = random.Random(len(groups))
    segments = [(rng.choice(groups), i, s, s + rng.choice([0, 1, 5.5, 200])) for i, s in enumerate(times(rng, 300))]
    turns = [(rng.choice(groups), rng.choice("XYZ"), s, s + rng.choice([0, 2, 7.25])) for s in times(rng, 300)] + [(groups[0], "long", 0.0, 300.0)]
    want = {}
    for g, i, s, e in segments:
        total = defaultdict(float)
        for h, label, a, b in turns:
            if g == h and g is not None and min(e, b) > max(s, a):
                total[label] += min(e, b) - max(s, a)
        want[i] = min(((-round(v, 9), k) for k, v in total.items()), default=(0.0, J.UNKNOWN))
    a = spark.createDataFrame(segments, "g string, id long, start double, end double")
    b = spark.createDataFrame(turns, "g string, label string, start double, end double")
    for width in (None, 3.0):
        found = {r.id: (-r.seconds, r.label) for r in J.dominant(a, b, "g", width).collect()}
        assert found == want
    assert any(x[1] == J.UNKNOWN for x in want.values())


def nearest(t, points, direction):
    if direction != "nearest":
        points = [p for p in points if (p[0] <= t if direction == "backward" else p[0] >= t)]
    return min(points, key=lambda p: (abs(p[0] - t), p[1]), default=(None, None))


@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
@pytest.mark.parametrize("groups", [["hot"], ["a", "b", "c", "d"]])
def test_nearest_points(spark, groups, direction):
    rng = random.Random(len(groups))
    points = [(rng.choice(groups), i, t) for i, t in enumerate(times(rng, 400))] + [("only", 7, None)]
    probes = [(rng.choice(groups), i, t) for i, t in enumerate(times(rng, 400))] + [("only", 900, 1.0), ("none", 901, 1.0), (None, 902, 1.0), (groups[0], 903, None), (groups[0], 0, 5.0), (groups[0], 0, 5.0)]
    by_group = defaultdict(list)
    for g, i, t in points:
        if t is not None:
            by_group[g].append((t, i))
    want = sorted((i, None if t is None else nearest(t, by_group.get(g, []), direction)[1]) for g, i, t in probes)
    a = spark.createDataFrame(probes, "g string, id long, t double")
    b = spark.createDataFrame(points, "g string, pid long, t double")
    found = J.asof(a, b, "g", direction).collect()
    assert sorted(((r.id, r.pid) for r in found), key=lambda x: (x[0], x[1] is not None, x[1])) == sorted(want, key=lambda x: (x[0], x[1] is not None, x[1]))
    close = {(r.id, r.pid) for r in J.asof(a, b, "g", direction, tolerance=0.5).collect()}
    assert close == {(r.id, r.pid if r.distance is not None and r.distance <= 0.5 else None) for r in found}


def test_one_group_spreads(spark):
    """All rows belong to one user: no task of the sorted order holds them all."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).selectExpr("'hot' AS g", "id", "CAST(id * 7 % 20011 AS DOUBLE) AS t")
        found = J.asof(rows, rows.filter("id % 50 = 0").withColumnRenamed("id", "pid"), "g")
        assert found.filter("pid IS NULL").count() == 0 and found.count() == 20_000
        keys = [x for x in found.inputFiles()]
        assert len({f for f in keys if "graph-" in f}) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
