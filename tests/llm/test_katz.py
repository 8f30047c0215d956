import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm import katz

RNG = random.Random(4)
VOCAB = [f"w{k}" for k in range(60)]


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def brute(rows, order=2):
    """Katz backoff straight from its definition; a history is the tuple of the tokens before, "start" (0) included."""
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for d, _ in rows]
    c1, c = Counter(), {k: defaultdict(Counter) for k in range(2, order + 1)}

    def histories(ts, at, k):
        return tuple([0, *ts[:at]][-(k - 1) :])

    for (_, t), h in zip(rows, held):
        if not h:
            ts = tokens(t)
            for at, w in enumerate(ts):
                c1[w] += 1
                for k in c:
                    c[k][histories(ts, at, k)][w] += 1
    n, v = sum(c1.values()), len(c1)
    d = {}
    for k in c:
        types = Counter(r for f in c[k].values() for r in f.values())
        d[k] = katz.discounts(np.array([types[r] for r in range(1, katz.TOP + 2)]))
    p1 = lambda w: (c1[w] + 0.1) / (n + 0.1 * (v + 1))

    def p(k, h, w):
        if k == 1:
            return p1(w)
        # The shorter history drops the word farthest away, if there are as many as the order allows.
        lower = lambda x: p(k - 1, h[-(k - 2) :] if k > 2 else (), x)
        f = c[k].get(h)
        if not f:
            return lower(w)
        kept = sum(r * (d[k][r] if r <= katz.TOP else 1) for r in f.values())
        whole = sum(f.values())
        whole += kept >= whole
        if w in f:
            return f[w] * (d[k][f[w]] if f[w] <= katz.TOP else 1) / whole
        return (1 - kept / whole) / (1 - sum(map(lower, f))) * lower(w)

    out = []
    for (doc, t), h in zip(rows, held):
        s, b, known = 0.0, 0.0, 0
        ts = tokens(t)
        for at, w in enumerate(ts):
            s, b, known = s + math.log10(p(order, histories(ts, at, order), w)), b + math.log10(p1(w)), known + (c1[w] > 0)
        out.append((doc, h, len(ts), known, n, b, s))
    for k in c:  # every history's distribution sums to one; the last place is for all unknown words
        for h in [*list(c[k])[:25], ("never",) * (k - 1)]:
            assert abs(sum(p(k, h, w) for w in [*c1, "unknown"]) - 1) < 1e-9
    return out


def rows():
    out = []
    for k in range(300):
        n = RNG.randrange(25)
        out.append((k, " ".join(RNG.choices(VOCAB, weights=range(1, 61), k=n))))
    return [*out, (7, out[7][1]), (None, "w1 W2"), (400, None), (401, ""), (402, "w1\tw2 " * 4000), (403, "only here é")]


@pytest.mark.parametrize("size, order, hot", [(katz.SLICE, 2, katz.HOT), (500, 2, 100), (700, 3, 100)])
def test_scores_follow_brute_force(spark, size, order, hot, monkeypatch):
    data = [(d, t if t is None or len(t) < 9999 else t[: 15 * 40]) for d, t in rows()] if order > 2 else rows()
    monkeypatch.setattr(katz, "SLICE", size)
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, score string")
    got = sorted(map(tuple, katz.score(docs, order=order, hot=hot).collect()), key=repr)
    want = sorted(brute(data, order), key=repr)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9)
    assert katz.score(docs.limit(0)).count() == 0


def test_tables_hold_the_counts(spark):
    docs = spark.createDataFrame([(k + 1 + (k == 9), t) for k, t in enumerate(["a b a b c", "a b", "c"])], "doc_id long, text string")
    held = [zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in docs.collect()]
    want = Counter()
    for r, h in zip(docs.collect(), held):
        if not h:
            want.update(zip(["<s>", *r.text.split()], [*r.text.split(), "</s>"]))
    (pairs,) = katz.tables(docs, hot=1)
    assert sorted(r["count"] for r in pairs.collect()) == sorted(want.values())
    assert pairs.filter("history = 0").count() == len({w for h, w in want if h == "<s>"})


def test_packing():
    for arrays in ([np.arange(5, dtype=np.uint64) << np.uint64(60), np.zeros(0), np.array([1.5, -2.0])], [np.arange(300_000, dtype=np.uint32)]):
        back = katz.unpack(katz.pack(*arrays))
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, back, strict=True))


def test_discounts_are_between_zero_and_one():
    for types in ([100, 40, 20, 12, 8, 6], [0] * 6, [5, 9, 0, 3, 1, 50]):
        d = katz.discounts(np.array(types))
        assert ((d[1:] > 0) & (d[1:] < 1)).all()
