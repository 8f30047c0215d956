import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from textloom.llm import mixing


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by the words of the contract: share, cut what is above, share the excess again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out, free = share * sum(sizes.values()), dict.fromkeys(names, 0.0), list(names)
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        for s in free:
            out[s] += left * weight[s] / total
        left = 0.0
        for s in list(free):
            if out[s] >= most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
                free.remove(s)
    return out


def rows():
    rng = random.Random(7)
    out = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(int(rng.lognormvariate(4, 1)))), rng.choice(["hot"] * 6 + ["a", "b", "É", "Z", None])) for i in range(1500)]
    out += [(2000, None, "a"), (2001, "", "empty"), (2002, " \t\n", None), (2003, "x y\x85z\x0bq", "b"), (None, "no id", "b"), (2004, "w " * 5000, "long"), (5, "twin text here", "twins"), (5, "twin text here", "twins")]
    return out


def table(spark, data):
    return spark.createDataFrame([(*r, 1, "n") for r in data], "doc_id long, text string, source string, size int, node string")


def test_mix_follows_the_contract(spark, tmp_path, monkeypatch):
    data = rows()
    table(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    out = mixing.op12_mixing(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r["size"], r.source) for r in out) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in data)
    sizes, taken, biggest = Counter(), Counter(), defaultdict(int)
    for r in out:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r["size"])
    want = filled(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    assert all(abs(taken[s] - want[s]) <= biggest[s] / 2 + 1e-6 for s in sizes)
    assert abs(taken["hot"] - want["hot"]) < 0.02 * want["hot"]


def plan(spark, data, parts, **how):
    return sorted(map(repr, mixing.assign(table(spark, data).repartition(parts), bucket=100, fan=4, **how).collect()))


def test_reruns_agree_whatever_the_partitions(spark):
    data = rows()
    first = plan(spark, data, 3)
    assert first == plan(spark, data[::-1], 11) and first != plan(spark, data, 3, seed=2)


def test_trees_of_many_levels_keep_the_sums(spark):
    data = rows()
    out = mixing.assign(table(spark, data), bucket=20, fan=3).collect()
    assert len(out) == len(data)
    taken, target, biggest = Counter(), {}, Counter()
    for r in out:
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
        biggest[r.source] = max(biggest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= biggest[s] / 2 + 1e-6 for s in target)


@given(st.integers(1, 1000), st.floats(0.001, 0.999), st.integers(1, 1000), st.floats(0.001, 0.999))
def test_pivots_keep_words_and_chances(a, x, b, y):
    up, down = min(a * (1 - x), b * y), min(a * x, b * (1 - y))
    p = down / (up + down)
    outcomes = [mixing.pivot(a, x, b, y, p * 0.999), mixing.pivot(a, x, b, y, min(p * 1.001 + 1e-12, 0.9999999))]
    for u, v in outcomes:
        assert 0 <= u <= 1 and 0 <= v <= 1 and (u in (0, 1) or v in (0, 1))
        assert a * u + b * v == pytest.approx(a * x + b * y)
    if p * 1.001 + 1e-12 < 1:
        assert p * outcomes[0][0] + (1 - p) * outcomes[1][0] == pytest.approx(x, abs=1e-6)


def test_expected_copies_over_seeds(spark):
    """Of many seeds, a document is taken about as often as its fraction says."""
    data = [(i, "w " * (i % 9 + 1), "s" if i % 3 else "t") for i in range(40)]
    total, rate = Counter(), {}
    for seed in range(12):
        for r in mixing.assign(table(spark, data), seed=seed, bucket=10).collect():
            total[r.source] += r.copies
            rate[r.source] = r.target / r.source_size
    n = Counter(s for _, _, s in data)
    assert all(abs(total[s] / (12 * n[s]) - rate[s]) < 0.1 for s in rate)


def test_mixture_repeats_whole_rows(spark):
    data = rows()[:200] + rows()[-3:]
    docs = table(spark, data)
    copies = Counter()
    for r in mixing.assign(docs).collect():
        copies[r.doc_id, r.source] += r.copies
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +copies


def test_nothing_and_no_words(spark):
    assert mixing.assign(table(spark, [])).count() == 0
    out = mixing.assign(table(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.copies, r.target, r.source_size) for r in out] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        mixing.targets(mixing.sized(table(spark, [])), share=3)
