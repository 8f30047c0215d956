import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import spelling


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(v) == len(u) + 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def brute(counts, ratio=5):
    by_length = defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    near = {w: [v for m in (len(w) - 1, len(w), len(w) + 1) for v in by_length[m] if v != w and one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("ab￿", max_size=6), max_size=40))
def test_pairs_of_a_trie(words):
    words = sorted(words)
    found = [tuple(sorted(p)) for p in spelling.near_pairs(words)]
    assert sorted(found) == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])]


def vocabulary(seed, letters, sizes, n):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
        words.add(w)
        k = rng.randrange(len(w))
        words.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    return {w: int(5 * 1.5 ** rng.randrange(20)) for w in words if len(w) >= 6}


@pytest.mark.parametrize(("letters", "sizes", "limit"), [("abé", [6, 7, 8], 20_000), ("ab", [6, 7, 9, 10], 3), ("abcdefgh÷", [6, 8, 13], 2)])
def test_variants_as_brute_force(spark, letters, sizes, limit):
    counts = vocabulary(len(letters), letters, sizes, 300)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    out = spelling.variants(words, limit=limit)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(brute(counts), key=repr)


def test_one_hot_half(spark):
    """All words share their first half and many their last letters: the group is dealt anew until it fits."""
    counts = {f"commonhalf{w}": n for w, n in vocabulary(9, "abc", [9, 10], 250).items()}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(words, limit=10).collect()), key=repr) == sorted(brute(counts), key=repr)


def contract_counts(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 5}


def test_query_follows_the_contract(spark, tmp_path):
    rng = random.Random(2)
    words = list(vocabulary(3, "abcdé", [6, 7, 8], 60))
    rows = [(i, " ".join(rng.choice([w, w.upper(), w.title(), w + ",", w + "9" + w]) for w in rng.choices(words, range(1, len(words) + 1), k=rng.randrange(80)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "x" * 100_000 + " "), (503, ("x" * 50_000 + "-") * 6), (504, "ÉÉÉÉÉÉ ééÉééé×÷" * 5), (3, rows[3][1])]
    spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, word string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = contract_counts(rows)
    want = brute(counts)
    assert sum(w[1] is not None for w in want) > 10 and any("x" * 6 in w for w in counts)
    assert sorted(map(tuple, spelling.op13_spelling(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_counts_do_not_depend_on_what_a_task_holds(spark):
    docs = spark.createDataFrame([(i, f"spelling speling word{'s' * (i % 3)} plenty") for i in range(50)] + [(None, "plenty spelling")], "doc_id long, text string").repartition(3)
    few, many = (sorted(map(tuple, spelling.vocabulary(docs, held=h).collect())) for h in (10, 1 << 20))
    assert few == many == [("plenty", 51), ("speling", 50), ("spelling", 51), ("wordss", 16)]


def test_groups_of_roots_and_nothing(spark):
    words = spark.createDataFrame([("colour", 1000), ("color", 9), ("colours", 6), ("coloors", 5)], "word string, n long")
    found = spelling.variants(words.filter("length(word) > 5"), ratio=5)
    assert [(r.root, r.words) for r in spelling.variant_groups(found).collect()] == [("colour", ["colours"])]
    assert spelling.variants(words.limit(0)).count() == 0


def test_whole_table_as_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    counts = contract_counts(rows)
    assert sorted(map(tuple, spelling.op13_spelling(spark, "/root/testdata/sf0.01").collect()), key=repr) == sorted(brute(counts), key=repr)
