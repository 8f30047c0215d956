import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import secrets

RNG = random.Random(3)


def hexes(n, size=40):
    return ["".join(RNG.choice("0123456789abcdef") for _ in range(size)) for _ in range(n)]


WORDS = ["".join(RNG.choice("etaoinshrdluetaoin") for _ in range(RNG.randrange(3, 22))) for _ in range(4000)]


def brute(text):
    """The fixed patterns as stated: leftmost matches of each, short ones dropped."""
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return [(a, ("assign", "access", "hex")[k], b) for a, k, b in sorted(out)]


TEXTS = [
    None, "", "é token = \"" + hexes(1)[0] + "\" end", "token: secret: abcdefghijklmnop", "PassWD='short' API_KEY=ABCDEFGHIJKL.x", "ſecret=abcdefghijklmnop",
    "AKIAAKIA" + "X" * 12 + "é" + "AKIA123", "0123456789abcdef0", "x" * 70_000 + " " + hexes(1, 64)[0], "zürich " * 10 + hexes(1)[0] + "=" + hexes(1)[0],
]


def test_base_spans_follow_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)] + [(None, "token=" + "a" * 20, "c"), (2, TEXTS[2], "c")], "doc_id long, text string, spans string")
    for formats in (None, secrets.fit({"hex": hexes(200)}, WORDS)):
        rows = secrets.find(docs, formats).collect()
        assert len(rows) == len(TEXTS) + 2
        for r in rows:
            text = "token=" + "a" * 20 if r.doc_id is None else TEXTS[r.doc_id] or ""
            base = [tuple(x) for x in r.base]
            assert base == brute(text)
            assert set(base) <= {tuple(x) for x in r.spans}
    assert secrets.learn(docs.limit(0)) is None
    assert secrets.digests(secrets.find(docs.limit(0), None)).count() == 0


def test_random_texts(spark):
    pieces = ["token", "Secret", "apikey", ":", "=", " ", '"', "'", "AKIA", "0a1b2c3d4e", "ABCDEF12", "é", "longishword", "\n", "/+_.-"]
    texts = ["".join(RNG.choice(pieces) for _ in range(RNG.randrange(30))) for _ in range(500)]
    import pyarrow as pa

    found = secrets.scan(pa.array(texts, pa.large_string()), None)
    assert [b for b, _ in found] == [brute(t) for t in texts]


def test_inferred_formats_tell_secrets_from_words():
    formats = secrets.fit({"hex": hexes(300), "access": ["AKIA" + "".join(RNG.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(200)]}, [w for w in WORDS if len(w) >= 12])
    secret = hexes(200, 32) + ["AKIA" + "".join(RNG.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(100)]
    words = ["".join(RNG.choice("etaoinshrdluetaoin") for _ in range(RNG.randrange(12, 22))) for _ in range(1000)]
    assert formats.chosen(*secrets.as_codes(secret)).mean() > 0.98
    assert formats.chosen(*secrets.as_codes(words)).mean() < 0.01


def test_states_of_one_language_are_merged():
    # Lengths are geometric, so that every state of a phase has the same future.
    a = secrets.infer(["ag" * (1 + min(30, int(RNG.expovariate(0.3)))) for _ in range(2000)] + ["7"] * 500)
    assert len(a.step) < 12  # the prefix tree has over 30 states
    codes, bounds = secrets.as_codes(["agagag", "7", "77"])
    s = a.score(codes, bounds)
    assert s[1] > s[2] and np.isfinite(s).all()


def test_learning_from_documents(spark):
    """Labelled keys teach their format; unlabelled ones are reported whole, in whole texts, words are not."""
    keys = ["".join(RNG.choice("GHJKLMNPQRSTVWXYZ23456789") for _ in range(28)) for _ in range(330)]
    docs = spark.createDataFrame([(i, f"{' '.join(RNG.sample(WORDS, 40))} token = \"{h}\"") for i, h in enumerate(keys[:300])], "doc_id long, text string")
    formats = secrets.learn(docs)
    texts = [f"sée {' '.join(RNG.sample(WORDS, 30))} {k} {' '.join(RNG.sample(WORDS, 200))} {k}" for k in keys[300:]]
    hidden = spark.createDataFrame([*enumerate(texts), (99, " ".join(RNG.sample(WORDS, 300)))], "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secrets.find(hidden, formats).collect()}
    hits = sum(found[i] == [(m.start(), "format", m.end()) for m in re.finditer(k, t)] for i, (k, t) in enumerate(zip(keys[300:], texts, strict=True)))
    assert hits >= 28 and found[99] == []


def test_the_sample_is_there_at_any_size(spark):
    rows = spark.range(100_000)
    for total, want in ((100_000, 20_000), (10_000_000, 200), (1, 100_000)):
        n = rows.filter(secrets.sampled(F.col("id"), total, 20_000)).count()
        assert abs(n - want) <= 6 * want**0.5
    # More documents than 20,000 million: the bound of the hash is still above 0.
    assert rows.filter(secrets.sampled(F.lit(None).cast("long"), 10, 20)).count() == 0
    assert 20_000 * (1 << 63) // 10**13 > 10**9


def test_values_beyond_the_letters_are_left_out(spark):
    docs = spark.createDataFrame([(i, f'token = "{h}"') for i, h in enumerate(hexes(40, 1000))] + [(99, "plainwordswithoutblanks andanotherone onceagainwords")], "doc_id long, text string")
    assert secrets.learn(docs, sample_letters=10) is None and secrets.learn(docs, sample_letters=5_000) is not None


def test_every_document_teaches(spark):
    docs = [(i, " ".join(RNG.sample(WORDS, 40))) for i in range(400)]
    kinds = [f"AKIA{'Q7' * 8}", f'token = "{hexes(1)[0]}"', hexes(1, 30_000)[0]]
    for i, x in enumerate(kinds):
        docs[100 * i + 5] = (100 * i + 5, f"{x} {docs[100 * i + 5][1]}")
    formats = secrets.learn(spark.createDataFrame(docs, "doc_id long, text string"), sample_docs=40)
    assert formats is not None and len(formats.kinds) == 3


def test_runs_that_base_spans_leave_in_part_are_reported():
    import pyarrow as pa

    class All:
        def chosen(self, codes, bounds):
            return np.ones(len(bounds) - 1, bool)

    text = "0123456789abcdef" + "ZYXWVUTSRQPONMLK" + " token=ABCDEFGHIJKLMNOP"
    ((base, spans),) = secrets.scan(pa.array([text], pa.large_string()), All())
    assert [k for _, k, _ in base] == ["hex", "assign"] and [x for x in spans if x[1] == "format"] == [(0, "format", 32)]


def test_all_values_are_counted(spark):
    """The frequencies of an automaton are those of all values, however many there are and however rare their states."""
    values = sorted(set(hexes(3000, 24)))
    longest = "f0" * 40_000
    docs = spark.createDataFrame([(i, f'token = "{v}" {w}plainwords') for i, (v, w) in enumerate(zip([*values, longest], (WORDS * 2)[: len(values) + 1], strict=True))], "doc_id long, text string")
    formats = secrets.learn(docs)
    hexed = formats.kinds[1]
    # One state: 3,000 values of 24 symbols and one of 80,000 end 3,001 times.
    codes = secrets.CLASS[np.frombuffer("".join([*values, longest]).encode(), np.uint8)]
    assert len(hexed.step) == 2
    assert 2 ** hexed.end[0] == pytest.approx((len(values) + 1) / (len(codes) + len(values) + 1), rel=1e-4)
    step, counts = secrets.merged(secrets.PrefixTree(values))
    assert secrets.passages(step, *secrets.as_codes([*values, longest])).sum() == len(codes) + len(values) + 1
    # The steps of the prefix tree, counted by hashes, are those of the tree.
    node, symbol, below, n = (x.tolist() for x in secrets.prefixes(*secrets.as_codes(values[:200])))
    nodes = {}
    for row in zip(node, symbol, below, n, strict=True):
        nodes.setdefault(row[0], {})[row[1]] = (row[2], row[3])
    tree, plain = secrets.PrefixTree.of(nodes, secrets.ROOT), secrets.PrefixTree(values[:200])
    assert len(tree.ends) == len(plain.ends) and sorted(map(sorted, tree.count)) == sorted(map(sorted, plain.count)) and sum(tree.ends) == 200
    assert all((a == b).all() for a, b in zip(secrets.merged(tree), secrets.merged(plain), strict=True))


def test_no_value_is_left_out(spark):
    """Far more values and ordinary runs than the driver would hold, and one of over 65,536 letters, reach the learner."""
    texts = [f'{w} token = "{v}"' for v, w in zip(hexes(2500), hexes(2500, 13), strict=True)] + ["token=" + "ab" * 40_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("text", "true AS ordinary")
    n = {r["kind"]: r["count"] for r in secrets.values_of(rows).groupBy("kind").count().collect()}
    assert n["assign"] == 2501 and n["hex"] == 2501 and n[""] == 2500
