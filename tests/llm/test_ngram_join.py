import random
import re

import numpy as np
import pytest

from textloom.llm import ngram_join as nj
from textloom.llm.components import components

RNG = random.Random(8)
VOCAB = ["".join(RNG.choice("abcdefghiné") for _ in range(RNG.randrange(1, 7))) for _ in range(300)]


def brute(rows, k, percent):
    def lower(t):
        return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(rows)))

    def top(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    comp[top(i)] = top(j)
    name = {}
    for i, (d, _) in enumerate(rows):
        name.setdefault(top(i), []).append(d)
    ids = {r: min((d for d in v if d is not None), default=None) for r, v in name.items()}
    return sorted(((d, len(sets[i]), ids[top(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def corpus():
    rows, n = [], 0

    def put(t):
        nonlocal n
        rows.append((n * 7 % 1009, t))
        n += 1

    passage = RNG.choices(VOCAB, k=30)
    for _ in range(40):
        base = RNG.choices(VOCAB, k=RNG.randrange(1, 120))
        if RNG.random() < 0.4:
            base += passage
        put(" ".join(base))
        for _ in range(RNG.randrange(4)):
            copy = list(base)
            for _ in range(RNG.randrange(4)):
                copy[RNG.randrange(len(copy))] = RNG.choice(VOCAB)
            put(" ".join(copy).replace(" ", RNG.choice([" ", "\n", "  "])))
    base = RNG.choices(VOCAB, k=200)
    for k in range(60):  # one large group of near copies, a chain at its ends
        copy = list(base)
        copy[k * 3 % 200] = f"new{k}"
        put(" ".join(copy))
    for t in (None, "", " \t ", "one", "ONE", "one two", "One  Two", "x " * 9000):
        put(t)
    return rows


@pytest.mark.parametrize("near, block, k, percent", [(nj.NEAR, nj.BLOCK, 4, 85), (2, 8, 4, 85), (nj.NEAR, nj.BLOCK, 5, 80), (4, 16, 2, 55)])
def test_components_follow_brute_force(spark, near, block, k, percent):
    rows = corpus()
    rows += [rows[3], (None, rows[3][1]), (None, "nothing like it at all here"), (5000, rows[-9][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int")
    out = nj.join(docs, k, percent, near=near, block=block)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=repr) == brute(rows, k, percent)


def test_stage_keeps_one_of_each_group(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row_key int")
    kept = nj.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _, c in brute(rows, 5, 80) if d == c})
    assert nj.deduplicated(docs.limit(0)).count() == 0
    assert nj.join(docs.limit(0)).count() == 0


def test_traversal_loses_no_link():
    sets = [np.unique(np.random.default_rng(k % 7).integers(0, 1 << 60, 330 + k % 13).astype(np.uint64))[: 325 + k % 5 * 7] for k in range(150)]
    size = np.array([len(s) for s in sets])
    bits = [nj.signature(s) for s in sets]
    assert len({len(b) for b in bits}) == 2
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if nj.linked(sets[a], sets[b], 85)}
    order = lambda found: {(min(a, b), max(a, b)) for i, j in found for a, b in zip(i.tolist(), j.tolist())}
    assert want and want <= order(nj.candidates(size, bits, 85))
    side = (np.arange(150) >= 60).astype(np.int64)
    got = order(nj.candidates(size, bits, 85, np.arange(150), side))
    assert {(a, b) for a, b in want if a < 60 <= b} <= got and all(a < 60 <= b for a, b in got)
    assert not order(nj.candidates(size, bits, 85, np.zeros(150, np.int64)))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(200, 260)] + [(7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(found[i] == 100 for i in range(101, 141)) and all(found[i] == 5 for i in range(200, 260)) and 7 not in found


def test_pairs_of_blocks_are_searched_whole(spark):
    # Pairs {hot, own, p, q}: the prefixes (two least hashes) of the two sets share the hot word's hash alone.
    words = sorted((f"w{i}" for i in range(3000)), key=lambda w: int(nj.shingle_sets(nj.pa.array([w], nj.pa.large_string()), 1)[0][0]))
    hot, own, rest = words[0], words[1:1001], words[1001:]
    rows = [(2 * k + side, " ".join([hot, own[2 * k + side], rest[2 * k], rest[2 * k + 1]])) for k in range(500) for side in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = nj.join(docs, 1, 60, near=2, block=50)
    assert {r.doc_id: r.component_id for r in out.collect()} == {d: d - d % 2 for d, _ in rows}
