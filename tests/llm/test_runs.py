import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import runs


def brute(w, least):
    """All runs by definition: for each period, maximal stretches of equal words; the smallest period of each stretch."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 12))
def test_runs_of_few_letters(w, least):
    assert runs.runs(w, least) == brute(w, least)


def noisy(rng):
    w = [rng.randrange(rng.choice([2, 3, 30])) for _ in range(rng.randrange(1, 20))]
    while len(w) < 150:
        k = rng.randrange(1, len(w) + 1)
        w += (w[-k:] * rng.randrange(1, 4))[: rng.randrange(1, 60)]
        w += [rng.randrange(5) for _ in range(rng.randrange(3))]
    return w


def test_runs_of_repetitive_sequences():
    rng = random.Random(3)
    for _ in range(300):
        w = noisy(rng)
        for least in (1, 2, 12):
            assert runs.runs(w, least) == brute(w, least)
    fibonacci = [0]
    last = [1]
    while len(fibonacci) < 200:
        fibonacci, last = fibonacci + last, fibonacci
    assert runs.runs(fibonacci, 2) == brute(fibonacci, 2)
    assert runs.runs([7] * 500, 12) == [(0, 500, 1)]


def test_factors_are_longest_earlier_sequences():
    rng = random.Random(4)
    for _ in range(100):
        w = noisy(rng)[:80]
        place = 0
        for start, size, source in runs.factors(w):
            assert start == place
            place += size
            if source >= 0:
                assert source < start and w[source : source + size] == w[start:place]
            longest = max((k for j in range(start) for k in range(len(w) - start + 1) if w[j : j + k] == w[start : start + k]), default=0)
            assert size == max(longest, 1)
        assert place == len(w)


def contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w, 12)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def rows():
    rng = random.Random(5)
    texts = [None, "", " \t\r\n", "one", "a b " * 40, "x y\x85z " * 13 + "A a", "word " * 3000, " ".join(map(str, range(900))), "é ü é ü é ü\x0bé ü é ü é ü é ü"]
    for _ in range(60):
        texts.append("".join(f"w{x}" + rng.choice([" ", "\n", "  ", "\x0c"]) for x in noisy(rng)))
        texts.append(" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(300))))
    return [*enumerate(texts), (4, texts[4])]


def test_query_follows_the_contract(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows()], "doc_id long, text string, runs int, collapsed string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = runs.op11_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [contract(i, t) for i, t in rows()]
    assert sum(w[1] for w in want) > 50 and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows()) > 5
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_find_gives_texts_and_nothing_of_nothing(spark):
    docs = spark.createDataFrame([(None, "a b " * 9 + "c", 1)], "doc_id long, text string, n_words int")
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find(docs).collect()] == [(None, 19, [(0, 18, 2)], "a b c")]
    assert runs.find(docs.limit(0)).count() == 0


def test_whole_tables_as_brute_force(spark):
    """On the documents of the smallest scale factor."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in runs.op11_runs(spark, sf).collect():
        if len(texts[r.doc_id] or "") < 6000:
            assert tuple(r) == contract(r.doc_id, texts[r.doc_id])
