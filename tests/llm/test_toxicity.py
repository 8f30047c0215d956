import random

import numpy as np
import pyarrow as pa

from textloom.llm import toxicity

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("etaoinshrdlu") for _ in range(RNG.randrange(2, 9))) for _ in range(600)]
BAD = ["grumblix", "grumblor", "snarkel", "zogfool"]


def text(toxic, junk):
    words = RNG.choices(WORDS, k=RNG.randrange(30, 90))
    for _ in range(8 if toxic else 0):
        words.insert(RNG.randrange(len(words)), RNG.choice(BAD) + RNG.choice(["", "!", "en"]))
    return " ".join(words[:10] * 6 if junk else words)


def rows(n, first=0):
    out = []
    for i in range(first, first + n):
        toxic, junk = int(RNG.random() < 0.2), int(RNG.random() < 0.3)
        out.append((i, text(toxic, junk), 1 - junk, toxic))
    return out


def test_held_out_accuracy_and_stage(spark):
    train, test = rows(1500), rows(500, 2000)
    odd = [(5000, None, 1, 0), (5001, "", 1, 0), (5002, " ".join(WORDS) * 40, 1, 0), (None, "plain words", 1, 0)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in [*train, *test, test[0], *odd]], "doc_id long, text string, p_toxic string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in train] + [(train[0][0], 1, train[0][3])], "doc_id long, quality int, toxic int")
    chain = toxicity.learn(docs, labels)
    out = toxicity.score(docs, chain).collect()
    assert len(out) == docs.count()
    truth = {i: x for i, _, _, x in [*test, *odd]}
    flagged = {r.doc_id for r in out if r.toxic}
    held = [i for i in truth if i is not None]
    assert np.mean([(i in flagged) == bool(truth[i]) for i in held]) > 0.98
    assert all(0 <= p <= 1 for r in out for p in (r.p_low_quality, r.p_toxic, r.p_severe))
    kept = toxicity.clean(docs, chain)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r.toxic for r in out)


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows(20)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same = spark.createDataFrame([(i, None, 0) for i in range(20)], none.schema)
    for labels in (none, same):
        chain = toxicity.learn(docs, labels)
        assert toxicity.score(docs, chain).filter("toxic").count() == 0
    assert toxicity.score(docs.limit(0), chain).count() == 0


def test_out_of_fold_chain_uses_earlier_categories():
    y = np.array([1, 0] * 150)
    noise = pa.array([text(0, 0) + (" grumblix" if k else "") for k in y], pa.large_string())
    chain = toxicity.fit_chain(noise, {"first": y, "second": y})
    assert chain.models[1].before[0] > 0.1
    p = chain.predict_texts(noise, {})
    assert ((p >= chain.thresholds) == y[:, None]).mean() > 0.98


def test_threshold():
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1.0, 1, 0, 0])) == 0.55
    assert toxicity.best_threshold(np.array([0.9]), np.array([0.0])) == 2.0
