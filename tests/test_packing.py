import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.operators import packing as P
from textloom.operators import ranks


def fold(segments, most, overlap):
    """One segment after another, as the definition says."""
    out, now, fresh = [], [], 0
    for s in segments:
        if now and sum(len(x[3]) + 1 for x in now) + len(s[3]) > most:
            out.append(now)
            now, fresh = now[-overlap:] if overlap else [], 0
        now, fresh = [*now, s], fresh + 1
    if fresh:
        out.append(now)
    return [(k, len(out), c[0][1], c[-1][2], " ".join(x[3] for x in c)) for k, c in enumerate(out)]


@pytest.mark.parametrize(("groups", "overlap"), [(1, 2), (5, 2), (3, 0)])
def test_segments_as_the_fold(spark, groups, overlap):
    rng = random.Random(groups)
    rows = [(rng.randrange(groups), float(i), i + 1.0, "x" * rng.choice([0, 5, 30, 80, 400])) for i in range(300)]
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    want = sorted((g, *c) for g, rs in by.items() for c in fold(rs, 200, overlap))
    found = P.segment_chunks(spark.createDataFrame(rows, "episode long, start double, end double, text string").repartition(5), 200, overlap)
    assert sorted(map(tuple, found.collect())) == want
    assert P.segment_chunks(spark.createDataFrame([], "episode long, start double, end double, text string")).count() == 0


def test_page_windows(spark):
    rng = random.Random(2)
    pages = [(d, p, " ".join(f"w{d}_{p}_{k}" for k in range(rng.choice([3, 60, 61, 300])))) for d in (1, 2) for p in range(12)] + [(3, 1, None), (3, 2, "few words")]
    want = set()
    for d in (1, 2):
        words = [(p, w) for dd, p, t in pages if dd == d and t and len(t.split()) >= 50 for w in t.split()]
        for s in range(0, len(words), 70):
            part = words[s : s + 100]
            want.add((d, s, tuple(dict.fromkeys(p for p, _ in part)), " ".join(w for _, w in part)))
    found = P.page_windows(spark.createDataFrame(pages, "doc_id long, page long, text string").repartition(4), 100, 30)
    rows = [(r.doc_id, r.start, tuple(r.pages), r.chunk) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.randrange(9)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, t long, v long").repartition(6)
    seen, want = defaultdict(lambda: [0, 0]), []
    for g, t, v in rows:
        want.append((g, t, v, *seen[g]))
        seen[g][0] += 1
        seen[g][1] += v
    assert sorted(map(tuple, ranks.running(df, "g", [F.col("t")], F.col("v")).collect()), key=repr) == sorted(want, key=repr)
