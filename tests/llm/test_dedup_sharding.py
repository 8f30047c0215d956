import hashlib
import re
import zlib
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import exact_dedup, sharding

ROWS = [(1, "a b"), (2, "ab"), (3, " a\tb "), (3, " a\tb "), (4, None), (5, ""), (6, "ü" * 50_000), (7, "x"), (None, "x"), (8, "a b"), (9, "a b"), (10, "\x0b")]
SCHEMA = "doc_id long, text string, digest string, SALT string"


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "d", "s") for r in rows], SCHEMA)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    return {n: (min(g)[3], len(g)) for n, g in groups.items()}


def check(spark, rows, **how):
    found = exact_dedup.decisions(docs(spark, rows), **how).collect()
    want = brute(rows)
    by_sha = {hashlib.sha256(n.encode()).hexdigest(): w for n, w in want.items()}
    assert len(found) == len(rows)
    for r in found:
        assert (r.keep_id, r.group_size) == by_sha[r.text_sha256]
    assert sorted(r.text_sha256 for r in found if r.kept) == sorted(by_sha)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_decisions_follow_brute_force(spark):
    check(spark, ROWS)
    check(spark, [])
    check(spark, [(i, "same  text" if i % 3 else f"t{i % 7}") for i in range(300)])


def test_colliding_digests_are_told_apart_by_content(spark):
    check(spark, ROWS, digest=lambda c: F.substring(F.sha2(c, 256), 1, 0))


def test_deduplicated_keeps_columns_and_one_row_each(spark):
    for digest in (exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 0)):
        df = docs(spark)
        out = exact_dedup.deduplicated(df, digest=digest)
        assert out.columns == df.columns

        kept = {re.sub(r"[\x20\x09-\x0D]", "", r.text or ""): r.doc_id for r in out.collect()}
        assert kept == {n: w[0] for n, w in brute(ROWS).items()}
        assert out.count() == len(kept)


def best_capacity(sizes, shards):
    cap = max(sizes)
    while True:
        n, run = 1, 0
        for s in sizes:
            if run + s > cap:
                n, run = n + 1, 0
            run += s
        if n <= shards:
            return cap
        cap += 1


def test_sharding_is_minimax_over_whole_groups(spark):
    rows = [(i, f"text {i % 23} " + "y" * (i * 7 % 31)) for i in range(200)] + [(500, None), (501, ""), (501, ""), (502, "é" * 40_000)]
    out = sharding.assign(docs(spark, rows), shards=5).collect()
    assert len(out) == len(rows)
    text = dict(rows)
    where, load, slots, size = {}, defaultdict(int), defaultdict(list), defaultdict(int)
    for r in out:
        t = (text[r.doc_id] or "").encode()
        assert r["size"] == len(t) + 16 and r.text_crc32 == zlib.crc32(t)
        assert where.setdefault(t, r.shard) == r.shard
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        size[hashlib.sha256(t).digest()] += r["size"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    alone = max(size, key=size.get)
    rest = [size[g] for g in sorted(size) if g != alone]
    assert load[4] == size[alone]
    assert max(v for k, v in load.items() if k != 4) <= best_capacity(rest, 4)


def test_sharding_of_nothing_and_of_one_text(spark):
    assert sharding.assign(docs(spark, []), shards=3).count() == 0
    out = sharding.assign(docs(spark, [(i, "t") for i in range(10)]), shards=3).collect()
    assert len({r.shard for r in out}) == 1 and sorted(r.slot for r in out) == list(range(10))


@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 8))
def test_greedy_cuts_and_capacity(sizes, shards):
    groups = sharding.Groups.__new__(sharding.Groups)
    run = __import__("numpy").cumsum(sizes)
    groups.ids, groups.ends, groups.total, groups.top = [0], run[-1:], int(run[-1]), max(sizes)
    groups.held = __import__("collections").OrderedDict({0: run})
    cap, cuts = groups.minimax(shards)
    assert cap == best_capacity(sizes, shards) and len(cuts) < shards


@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 8))
def test_level_cuts_keep_the_capacity_and_even_shares(sizes, shards):
    import numpy as np

    groups = sharding.Groups.__new__(sharding.Groups)
    run = np.cumsum(sizes)
    groups.ids, groups.ends, groups.total, groups.top = [0], run[-1:], int(run[-1]), max(sizes)
    groups.held = __import__("collections").OrderedDict({0: run})
    cap = groups.minimax(shards)[0]
    cuts = [j for _, j in groups.level(cap, shards)]
    assert cuts == sorted(cuts) and len(cuts) < shards
    load = [sum(sizes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True)]
    assert max(load) <= cap
    if len(sizes) >= 8 * shards and max(sizes) * 4 * shards <= sum(sizes):
        assert min(load) >= sum(sizes) / shards - 2 * max(sizes)


def test_shards_of_a_table_are_near_equal(spark):
    rows = [(i, f"text {i} " + "y" * (i * 37 % 400)) for i in range(3000)]
    out = sharding.assign(docs(spark, rows), shards=40).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    n = [r.n for r in out]
    assert len(n) == 40 and min(n) > 0.8 * sum(n) / 40 and max(n) < 1.2 * sum(n) / 40
