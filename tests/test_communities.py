import random
from collections import defaultdict

import pytest

from textloom.operators import communities as C


def quality(edges, of):
    total, inside, degree = 0.0, defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        total += 2 * w
        degree[of[a]] += w
        degree[of[b]] += w
        if of[a] == of[b]:
            inside[of[a]] += 2 * w
    return sum(inside[c] / total - (degree[c] / total) ** 2 for c in degree)


def partitions(nodes):
    if not nodes:
        yield []
        return
    for rest in partitions(nodes[1:]):
        yield [[nodes[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [nodes[0], *rest[k]], *rest[k + 1 :]]


def sequential(edges):
    """Louvain one node after another."""
    groups = {x: {x} for e in edges for x in e[:2]}
    graph = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        graph[a][b] += w
        graph[b][a] += w
    while True:
        total = sum(sum(x.values()) for x in graph.values())
        degree = {u: sum(vs.values()) for u, vs in graph.items()}
        of, tot = {u: u for u in graph}, dict(degree)
        moved = True
        while moved:
            moved = False
            for u in sorted(graph):
                tot[of[u]] -= degree[u]
                to = defaultdict(float)
                for v, w in graph[u].items():
                    if v != u:
                        to[of[v]] += w
                to[of[u]] += 0
                best = min(to, key=lambda c: (-round(to[c] - degree[u] * tot[c] / total, 9), c != of[u], c))
                moved |= best != of[u]
                of[u] = best
                tot[best] += degree[u]
        if len(set(of.values())) == len(graph):
            return {x: u for u, xs in groups.items() for x in xs}
        new = defaultdict(lambda: defaultdict(float))
        for u, vs in graph.items():
            for v, w in vs.items():
                new[of[u]][of[v]] += w
        merged = defaultdict(set)
        for u, xs in groups.items():
            merged[of[u]] |= xs
        groups, graph = merged, new


def run(spark, edges):
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    return df, C.louvain(df)


def planted(rng, groups, size, inner, outer):
    nodes = [f"n{i:03}" for i in range(groups * size)]
    return [(a, b, rng.choice([0.5, 1.0, 2.0])) for i, a in enumerate(nodes) for j, b in enumerate(nodes) if i < j and rng.random() < (inner if i % groups == j % groups else outer)]


def test_against_all_partitions_of_small_graphs(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        edges = [(f"v{i}", f"v{j}", float(rng.randrange(1, 4))) for i in range(8) for j in range(i + 1, 8) if rng.random() < 0.4]
        df, found = run(spark, edges)
        of = {r.id: r.community for r in found.collect()}
        nodes = sorted(of)
        best = max(quality(edges, {x: k for k, p in enumerate(ps) for x in p}) for ps in partitions(nodes))
        assert quality(edges, of) >= best - 0.03
        assert C.partition_quality(df, found) == pytest.approx(quality(edges, of))
        assert all(of[c] == c and c == min(x for x in of if of[x] == c) for c in of.values())


def test_planted_communities_and_the_sequential_method(spark):
    rng = random.Random(3)
    edges = planted(rng, 5, 16, 0.6, 0.03)
    of = {r.id: r.community for r in run(spark, edges)[1].collect()}
    want = {f"n{i:03}": f"n{i % 5:03}" for i in range(80)}
    # One node has more edges into another community than into its own: its move is a gain.
    assert quality(edges, of) >= quality(edges, want) and sum(of[x] != want[x] for x in want) <= 1
    edges = planted(rng, 4, 14, 0.35, 0.1)
    of = {r.id: r.community for r in run(spark, edges)[1].collect()}
    assert quality(edges, of) >= quality(edges, sequential(edges)) - 0.03
    again = {r.id: r.community for r in run(spark, edges[::-1])[1].collect()}
    assert again == of


def test_loops_parallel_edges_and_nothing(spark):
    df, found = run(spark, [("a", "a", 1.0), ("a", "b", 1.0), ("b", "a", 2.0), ("c", "d", 1.0), ("x", None, 1.0), ("y", "z", 0.0)])
    assert {r.id: r.community for r in found.collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}
    assert C.louvain(df.limit(0)).count() == 0
