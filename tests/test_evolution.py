"""Evolving domains against a plain sequential version."""

import random

import pytest

from textloom.operators import evolution as E
from textloom.streaming import streams


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5


class Plain:
    """One batch after another, decided against the state before it; mergers by links."""

    def __init__(self):
        self.domains, self.members, self.vectors, self.next = {}, {}, {}, 0

    def batch(self, rows):
        names = {}
        for name, v in rows:
            if v and any(v):
                names.setdefault(name, []).append(v)
        before = {d: [x / x_["n"] for x in x_["total"]] for d, x_ in self.domains.items()}
        new = sorted(n for n in names if n not in self.members)
        for n in names:
            if n in self.members:
                self.domains[self.members[n]]["frequency"] += len(names[n])
        for n in new:
            v = min(names[n])
            best = min(((-round(cosine(v, c), 9), d) for d, c in before.items()), default=(0, None))
            if -best[0] >= 0.7:
                d = self.domains[best[1]]
                d["n"] += 1
                d["frequency"] += len(names[n])
                d["total"] = [a + b for a, b in zip(d["total"], v)]
                self.members[n] = best[1]
            else:
                self.domains[self.next] = {"name": n, "parent": best[1] if -best[0] >= 0.5 else None, "n": 1, "frequency": len(names[n]), "total": list(v)}
                self.members[n] = self.next
                self.next += 1
        ids = sorted(self.domains)
        root = {d: d for d in ids}
        for _ in ids:
            for a in ids:
                for b in ids:
                    if a < b and cosine(self.domains[a]["total"], self.domains[b]["total"]) >= 0.85:
                        root[a] = root[b] = min(root[a], root[b])
        for d in ids:
            if root[d] != d:
                x, to = self.domains.pop(d), self.domains[root[d]]
                to["n"] += x["n"]
                to["frequency"] += x["frequency"]
                to["total"] = [a + b for a, b in zip(to["total"], x["total"])]
        self.members = {n: root[d] for n, d in self.members.items()}
        for d, x in self.domains.items():
            p = root.get(x["parent"], x["parent"])
            x["parent"] = p if p != d else None


def batches(seed, sizes):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    names = {f"rel{i:02}": [x + rng.gauss(0, 0.45) for x in middles[i % 6]] for i in range(40)}
    names["none"], names["flat"] = None, [0.0] * 5
    return [[(n, names[n]) for n in rng.choices(sorted(names), k=k)] for k in sizes]


def compare(spark, path, plain):
    _, _, following, domains, members = E.state(spark, path)
    assert following == plain.next
    assert {r["name"]: r.domain for r in members.collect()} == plain.members
    found = {r.domain: r for r in domains.collect()}
    assert found.keys() == plain.domains.keys()
    for d, x in plain.domains.items():
        assert (found[d]["name"], found[d].parent, found[d].n, found[d].frequency) == (x["name"], x["parent"], x["n"], x["frequency"])
        assert found[d].total == pytest.approx(x["total"])


def table(spark, rows):
    return spark.createDataFrame(rows, "name string, vector array<double>")


@pytest.mark.parametrize("sizes", [[1, 1, 1, 1], [12, 9, 14]])
def test_batches_in_order(spark, tmp_path, sizes):
    plain = Plain()
    for k, rows in enumerate(batches(len(sizes), sizes)):
        assert E.evolve(table(spark, rows), str(tmp_path), k)
        plain.batch(rows)
    compare(spark, str(tmp_path), plain)
    # A batch that comes again, and one that broke off before its version was written, change nothing.
    assert not E.evolve(table(spark, batches(9, [5])[0]), str(tmp_path), len(sizes) - 1)
    table(spark, []).write.parquet(str(tmp_path / "domains" / "v99-broken"))
    compare(spark, str(tmp_path), plain)


def test_stream_of_batches(spark, tmp_path):
    plain, schema = Plain(), table(spark, []).schema
    for rows in batches(5, [8, 8]):
        table(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        E.run(streams.parquet_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "state")).awaitTermination()
        plain.batch(rows)
    compare(spark, str(tmp_path / "state"), plain)
    actions = {r.action for r in spark.read.parquet(str(tmp_path / "state/log/*")).select("action").distinct().collect()}
    assert {"new_domain"} <= actions <= {"new_domain", "assigned", "subdomain_created", "merged"}
