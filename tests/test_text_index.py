"""The stored index against plain scores: pruning, deltas, merging, reuse."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import text_index as I


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def corpus(n, seed=1, start=0):
    rng = random.Random(seed)
    out = [(start + i, " ".join(rng.choice(["the", "sea", "hill"] if rng.random() < 0.4 else ["rare", "stone", "Über", "a", "it", "moss", "fern", "x9y"]) for _ in range(rng.randrange(3, 60)))) for i in range(n)]
    return [*out, (start + n, None), (start + n + 1, ""), (start + n + 2, "ab c")]


def brute(rows, terms, k1=1.5, b=0.75, epsilon=0.25):
    toks = {i: [t for t in re.findall(r"[^\W_]+", (t or "").lower()) if len(t) > 2] for i, t in rows}
    n, avgdl = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(t for ts in toks.values() for t in set(ts))
    idf = {t: math.log((n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    out = {}
    for i, ts in toks.items():
        tf = Counter(ts)
        s = sum((idf[t] if idf[t] >= 0 else epsilon * mean) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(ts) / avgdl)) for t in terms if t in idf)
        if s > 0:
            out[i] = s
    return out


def close(found, want):
    assert {r.doc_id for r in found} == set(want)
    assert all(r.score == pytest.approx(want[r.doc_id], abs=1e-9) for r in found)


def test_scores_deltas_and_merging(spark, tmp_path):
    path, first, more = str(tmp_path / "index"), corpus(150), corpus(80, 2, 1000)
    terms = ["rare", "moss", "rare", "über", "unknown"]
    index = I.build(docs_of(spark, first), path, block=16, buckets=4)
    close(I.scores(index, terms).collect(), brute(first, terms))
    index = I.append(docs_of(spark, more + first[:20]), path, block=16)
    assert len(index.generations) == 2 and index.n == len(first) + len(more)
    close(I.scores(index, terms).collect(), brute(first + more, terms))
    merged = I.merge(spark, path, block=16)
    assert len(merged.generations) == 1 and merged.n == index.n and merged.mean_idf == pytest.approx(index.mean_idf)
    close(I.scores(merged, terms).collect(), brute(first + more, terms))
    tf = {r.doc_id: (r.score, r.matched) for r in I.tf_scores(merged, ["rare", "rare", "moss"]).collect()}
    toks = {i: [t for t in (t or "").lower().split() if len(t) > 2] for i, t in first + more}
    want = {i: ((2 * ts.count("rare") + ts.count("moss")) / len(ts), ("rare" in ts) + ("moss" in ts)) for i, ts in toks.items() if "rare" in ts or "moss" in ts}
    assert tf.keys() == want.keys() and all(tf[i] == (pytest.approx(want[i][0]), want[i][1]) for i in want)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_search_gives_the_best_and_reads_fewer_blocks(spark, tmp_path, k):
    rng = random.Random(5)
    rows = [(i, "pearl " * (40 if i % 97 == 0 else 1) + "word " * rng.randrange(5, 400)) for i in range(2000)] + [(5000 + i, "plain words only") for i in range(3000)]
    index = I.build(docs_of(spark, rows), str(tmp_path / "i"), block=32, buckets=4)
    want = brute(rows, ["pearl"])
    found = {r.doc_id: r.score for r in I.search(index, ["pearl"], k, first=2).collect()}
    best = sorted(want, key=lambda i: (-want[i], i))[:k]
    low = want[best[-1]]
    assert {i for i in want if want[i] >= low} <= set(found) and all(found[i] == pytest.approx(want[i]) for i in found)
    w = I.weights(index, ["pearl"])
    every, kept = I.blocks_of(index, w, I.K1, I.B).count(), I.reaching(index, w, k, first=2).count()
    assert kept < every * (0.5 if k < 21 else 0.75)  # 21 documents stand out


def test_only_buckets_of_the_terms_are_opened(spark, tmp_path):
    index = I.build(docs_of(spark, corpus(100)), str(tmp_path / "i"), buckets=8)
    plan = index.of_terms("postings", ["moss"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    heads = I.blocks_of(index, {"moss": 1.0}, 1.5, 0.75)._jdf.queryExecution().executedPlan().toString()
    assert "entries" not in heads.split("ReadSchema")[1]


def test_broken_runs_and_other_files_do_not_count(spark, tmp_path):
    path = str(tmp_path / "i")
    assert I.open_index(spark, path) is None
    rows = corpus(30)
    I.write_generation(*I.tokenised(docs_of(spark, rows), "doc_id", "text"), path, 16, 4)  # a run that ended before its version
    assert I.open_index(spark, path) is None
    index = I.build(docs_of(spark, rows), path)
    close(I.scores(index, ["moss"]).collect(), brute(rows, ["moss"]))
    for folder in ("a", "b"):
        docs_of(spark, rows if folder == "a" else rows[:9]).write.parquet(str(tmp_path / folder))
    a, b = (spark.read.parquet(str(tmp_path / x)) for x in "ab")
    first = I.index_of(a)
    assert I.index_of(a) == first and I.index_of(b).n == 9 and first.n == len(rows)


def test_nothing(spark, tmp_path):
    empty = I.build(docs_of(spark, []), str(tmp_path / "e"))
    assert empty.n == 0 and I.search(empty, ["a"], 3).count() == 0 and I.tf_scores(empty, ["a"]).count() == 0
    blank = I.build(docs_of(spark, [(1, None)]), str(tmp_path / "b"))
    assert blank.n == 1 and I.search(blank, ["abc"], 3).count() == 0
    index = I.append(docs_of(spark, [(2, "abc abc"), (3, "other text")]), str(tmp_path / "b"))
    assert index.n == 3 and [r.doc_id for r in I.search(index, ["abc"], 1).filter(F.col("score") > 0).collect()] == [2]
    assert I.search(index, [], 3).count() == 0


def test_documents_travel_whole(spark):
    """One row a document leaves the texts, with its terms counted; postings are made where a block's documents meet."""
    import pyarrow as pa

    rows = corpus(300, 7)
    sized, words = I.tokenised(docs_of(spark, rows), "doc_id", "text")
    want = {i: Counter(t for t in re.findall(r"[^\W_]+", (t or "").lower()) if len(t) > 2) for i, t in rows}
    assert {r.doc_id: Counter(dict(zip(r.terms, r.tfs, strict=True))) for r in words.collect()} == want and words.count() == len(rows)
    assert {r.doc_id: r.dl for r in sized.collect()} == {i: sum(c.values()) for i, c in want.items()}
    batch = pa.record_batch({"doc_id": [1, 2, 3], "dl": [2, 1, 4], "block": [0, 0, 1], "terms": [["sea", "hill"], ["sea"], ["sea"]], "tfs": [[1, 1], [1], [4]]})
    found = [r for b in I.grouped(iter([batch.slice(0, 1), batch.slice(1, 2)])) for r in b.to_pylist()]
    assert [(r["term"], r["block"], r["n"], r["max_tf"], r["min_dl"], [tuple(e.values()) for e in r["entries"]]) for r in found] == [
        ("sea", 0, 2, 1, 1, [(1, 1, 2), (2, 1, 1)]), ("hill", 0, 1, 1, 2, [(1, 1, 2)]), ("sea", 1, 1, 4, 4, [(3, 4, 4)]),
    ]
