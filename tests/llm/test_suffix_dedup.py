import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from textloom.llm import suffix_dedup as sd

RNG = random.Random(6)


def prose(n):
    return "".join(RNG.choice("abcdefgh é") for _ in range(n))


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k : k + length] for _, d in data for k in range(len(d) - length + 1))
    out = []
    for i, d in data:
        over = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                over[k : k + length] = True
        spans = int((over & ~np.r_[False, over[:-1]]).sum()) if len(d) else 0
        out.append((i, len(d), int(over.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~over])))
    return sorted(out, key=repr)


def corpus():
    passage, long = prose(70), prose(300)
    rows = []
    for k in range(60):
        t = prose(RNG.randrange(120))
        if k % 3 == 0:
            t += passage[RNG.randrange(8) : 62 + RNG.randrange(8)] + prose(RNG.randrange(50))
        if k % 5 == 0:
            t += long[RNG.randrange(100) : 150 + RNG.randrange(150)]
        rows.append((k, t))
    rows += [(100, long), (101, long), (102, long + "x" + long), (103, "a" * 500), (104, "ab" * 90), (105, None), (106, ""), (None, prose(45)), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize("length, anchor, chunk, block, hot", [(40, 20, sd.CHUNK, sd.BLOCK, sd.HOT), (40, 12, 2000, 400, 20), (25, 25, 500, 1000, 1)])
def test_bytes_left_follow_brute_force(spark, length, anchor, chunk, block, hot, monkeypatch):
    monkeypatch.setattr(sd, "HOT", hot)  # 1: no anchor is hot
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    out = sd.removed(docs, length, anchor, chunk=chunk, block=block).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out), key=repr) == brute(rows, length)
    assert sd.removed(docs.limit(0), length, anchor).count() == 0


def test_intervals_find_long_prefixes():
    for _ in range(20):
        parts = [bytes(RNG.choice(b"abc") for _ in range(RNG.randrange(1, 60))) for _ in range(RNG.randrange(1, 12))]
        parts += RNG.choices(parts, k=2)
        length = RNG.randrange(1, 9)
        weight = np.array([RNG.choice([1, 1, 2]) for _ in parts])
        count = Counter()
        for p, m in zip(parts, weight):
            for k in range(len(p) - length + 1):
                count[p[k : k + length]] += int(m)
        want = [[k for k in range(len(p) - length + 1) if count[p[k : k + length]] > 1] for p in parts]
        assert [x.tolist() for x in sd.repeated_windows(parts, weight, length)] == want


def test_production_length(spark):
    shared = prose(420)
    rows = [(1, prose(300) + shared + prose(500)), (2, shared[5:] + prose(90)), (3, prose(800)), (4, shared[:350])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.removed(docs).collect()), key=repr)
    assert got == brute(rows, sd.LENGTH) and hashlib.sha256(got[0][4]).hexdigest()


def test_query_carries_the_text_left(spark, tmp_path):
    shared = "é" * 150 + prose(300)
    spark.createDataFrame([(1, "ab" + shared + "ß"), (2, shared + "c"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in sd.op5_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: "abß", 2: "c", 3: ""}


def brute_passages(rows, length):
    words = [[w.lower() for w in (t or "").split()] for _, t in rows]
    holders = {}
    for r, w in enumerate(words):
        for k in range(len(w) - length + 1):
            holders.setdefault(tuple(w[k : k + length]), set()).add(r)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        over = [False] * len(w)
        for k in range(len(w) - length + 1):
            if len(holders[tuple(w[k : k + length])]) > 1:
                over[k : k + length] = [True] * length
        out.append((i, sum(b and not a for a, b in zip([False, *over], over, strict=False)), sum(over)))
    return sorted(out, key=repr)


def wordy(n):
    return [RNG.choice(("a", "é", "the", "Of", "x1", "und", "zu", "bei")) for _ in range(n)]


@pytest.mark.parametrize("length, anchor, chunk, block, hot", [(12, 4, sd.CHUNK, sd.BLOCK, sd.HOT), (12, 6, 4000, 800, 20), (7, 7, 900, 2000, 1)])
def test_passages_follow_brute_force(spark, length, anchor, chunk, block, hot, monkeypatch):
    monkeypatch.setattr(sd, "HOT", hot)
    shared, long = wordy(20), wordy(90)
    rows = []
    for k in range(60):
        t = wordy(RNG.randrange(40))
        if k % 3 == 0:
            t += shared[RNG.randrange(4) : 16 + RNG.randrange(4)] + wordy(RNG.randrange(20))
        if k % 5 == 0:
            t += long[RNG.randrange(30) : 45 + RNG.randrange(45)]
        rows.append((k, RNG.choice((" ", "\n", "\t ")).join(t)))
    own, twin = wordy(30), wordy(25)
    rows += [(100, " ".join(own + own)), (101, " ".join(twin)), (101, " ".join(twin)), (102, " ".join(long).upper().replace("É", "é")), (103, "a " * 80), (104, "b " * 80), (105, "b\n" * 30), (106, None), (107, ""), (None, " ".join(shared))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sd.removed(docs, chunk=chunk, block=block, passage=length, word_anchor=anchor).collect()
    got = sorted(((r.doc_id, r.n_passages, r.n_passage_words) for r in out), key=repr)
    assert got == brute_passages(rows, length)
    assert sd.removed(docs.limit(0), passage=length).count() == 0


def test_word_segments_are_alike_in_any_batch():
    texts = [wordy(n) for n in (200, 3, 0, 41, 90)]
    words = [np.array([hash(w) % (1 << 63) for w in t], np.uint64) for t in texts]
    bounds = np.r_[0, np.cumsum([len(w) for w in words])]
    want = [sorted(zip(*(x.tolist() for x in sd.word_segments(np.array([0, len(w)]), w, 10, 4)[1:]), strict=True)) for w in words]
    for piece in (1, 7, 50, sd.PIECE):
        found = sd.word_segments(bounds, np.concatenate(words), 10, 4, piece)
        got = [[] for _ in texts]
        for k, *rest in zip(*(x.tolist() for x in found), strict=True):
            got[k].append(tuple(rest))
        assert [sorted(x) for x in got] == want


def test_query_finds_passages_of_few_bytes(spark, tmp_path):
    passage = [f"w{k}" for k in range(51)]  # 194 bytes
    inner = [f"v{k}" for k in range(51)]
    rows = [(1, " ".join(["ab", *passage, "c"])), (2, "d\n" + "\n".join(passage)), (3, " ".join([*inner, *inner])), (4, " ".join(passage[1:])), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_passages, r.n_passage_words) for r in sd.op5_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, 1, 51), 2: (0, 1, 51), 3: (0, 0, 0), 4: (0, 0, 0), 5: (0, 0, 0)}
