"""Toxicity by classifier chains.

Categories are predicted one after another by linear (logistic) models. Each later model also gets the probabilities of
the categories before it; in training those come from models of other folds (out-of-fold), features included, so that a
later model never sees a probability that was fitted to its own row; equal texts are in one fold. Features are words and word beginnings of 3 to 7 letters,
chosen by how much more often they stand in texts of one class and scaled by their log-count ratio. The probability from
which a document is toxic is the one that gives the out-of-fold predictions the best F1.

The models are fitted on the driver from a bounded sample: at most TRAIN_ROWS labelled rows, the first by a hash of
their id. Scoring reads every row and whole text, within bounded batches, without a shuffle.

Defined results: null counts as the empty text, whose features are all zero; a row with a null id is scored too; an id
with several labels counts as toxic (or of low quality) if one of them says so; without labelled rows of both classes a
category has the share of its positive rows, or 0, as its probability, and is never raised above it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import compact, doc_of, gather, give_back, released, slices, table, texts_of, words_of

TRAIN_ROWS, FEATURES, LEAST_DOCS, FOLDS, ROUNDS, L2 = 6_000, 6_000, 6, 3, 200, 1e-3
#: Lengths of word beginnings, and letters of a word that count.
PREFIXES, WORD = (3, 4, 5, 6, 7), 40
#: Features are told apart by a hash of so many values; training texts are read in runs of so many rows.
HASHED, RUN_ROWS = 1 << 21, 256
#: Words whose features a scoring task remembers.
CACHED = 200_000
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def categories() -> dict[str, Column]:
    """In the order of the chain; over the columns quality and toxic of labels. "severe" has no label of its own: toxic
    and of low quality."""
    quality, toxic = F.coalesce(F.col("quality"), F.lit(1)), F.coalesce(F.col("toxic"), F.lit(0))
    return {"low_quality": quality == 0, "toxic": toxic == 1, "severe": (toxic == 1) & (quality == 0)}


def features_of(word: str) -> tuple[int, ...]:
    word = word.strip(STRIP).lower()[:WORD]
    if not word:
        return ()
    return tuple({zlib.crc32(x.encode()) % HASHED for x in (word, *[word[:k] + "*" for k in PREFIXES if len(word) >= k])})


@dataclass
class Rows:
    """Sparse rows: for each row a run of features and their values."""

    bounds: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        run = np.r_[0.0, np.cumsum(w[self.index] * self.value)]
        return run[self.bounds[1:]] - run[self.bounds[:-1]]

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.index, np.repeat(g, np.diff(self.bounds)) * self.value, n)

    def take(self, rows: np.ndarray) -> Rows:
        length = np.diff(self.bounds)[rows]
        bounds = np.r_[0, np.cumsum(length)]
        at = np.arange(bounds[-1]) + np.repeat(self.bounds[:-1][rows] - bounds[:-1], length)
        return Rows(bounds, self.index[at], self.value[at])


def sparse(texts: pa.Array, known: dict[int, int] | None, cache: dict[str, tuple[int, ...]]) -> Rows:
    """Feature rows of texts; `known` numbers the features that count, None lets every hash count."""
    bounds, distinct, codes = words_of(texts)
    ids: list[tuple[int, ...]] = []
    for w in distinct.to_pylist():
        found = cache.get(w)
        if found is None:
            found = features_of(w)
            if known is not None:
                found = tuple(known[f] for f in found if f in known)
            if len(w) <= WORD:
                cache[w] = found
        ids.append(found)
    width = HASHED if known is None else max(1, len(known))
    flat = np.fromiter((f for x in ids for f in x), np.int64)
    runs = np.r_[0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]
    doc = doc_of(bounds)
    many = max(1, len(ids))
    distinct_words = np.bincount(np.unique(doc * many + codes) // many, minlength=len(texts))
    found, ends = gather(flat, runs, codes)
    key = np.repeat(doc, np.diff(ends)) * width + found
    key, count = np.unique(key, return_counts=True)
    row = key // width
    value = np.log1p(count) / np.sqrt(np.maximum(1, distinct_words))[row]
    return Rows(np.searchsorted(row, np.arange(len(texts) + 1)), key % width, value)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Linear:
    """Logistic model over sparse features and the probabilities before it."""

    weights: np.ndarray
    before: np.ndarray
    bias: float

    def predict(self, rows: Rows, before: np.ndarray) -> np.ndarray:
        return sigmoid(rows.dot(self.weights) + before @ self.before + self.bias)


def fit_linear(rows: Rows, before: np.ndarray, y: np.ndarray, width: int) -> Linear:
    """Nesterov's gradient method on the logistic loss, each feature scaled by its log-count ratio."""
    n, k, pos = len(y), before.shape[1], int(y.sum())
    if pos == 0 or pos == n:
        return Linear(np.zeros(width), np.zeros(k), -40.0 if pos == 0 else 40.0)
    there = Rows(rows.bounds, rows.index, np.ones(len(rows.index)))
    inside, outside = there.back(y, width), there.back(1 - y, width)
    ratio = np.log((inside + 0.5) / (pos + 1)) - np.log((outside + 0.5) / (n - pos + 1))
    rows = Rows(rows.bounds, rows.index, rows.value * ratio[rows.index])
    square = Rows(rows.bounds, rows.index, rows.value**2)
    step = 1.0 / (0.25 * (float(np.percentile(square.dot(np.ones(width)), 99)) + k + 1) + L2)
    w, v = np.zeros(width + k + 1), np.zeros(width + k + 1)
    weight = np.where(y == 1, 1.0, pos / (n - pos)) / (2 * pos) if pos * 2 < n else np.full(n, 1 / n)
    weight = (weight + 1 / n) / 2
    for t in range(ROUNDS):
        z = rows.dot(v[:width]) + before @ v[width : width + k] + v[-1]
        g = weight * (sigmoid(z) - y)
        grad = np.r_[rows.back(g, width), g @ before, g.sum()] + L2 / n * np.r_[v[:-1], 0.0]
        new = v - step * grad
        v = new + t / (t + 3) * (new - w)
        w = new
    return Linear(w[:width] * ratio, w[width : width + k], float(w[-1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability with the best F1, half-way to the next lower one; 2 (never) without positive rows."""
    if not y.sum():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = 0
    k = int(np.argmax(f1))
    low = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float((p[order][k] + low) / 2)


@dataclass
class Chain:
    names: list[str]
    features: dict[int, int]
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def predict(self, rows: Rows) -> np.ndarray:
        before = np.zeros((len(rows.bounds) - 1, 0))
        for model in self.models:
            before = np.c_[before, model.predict(rows, before)]
        return before

    def predict_texts(self, texts: pa.Array, cache: dict[str, tuple[int, ...]]) -> np.ndarray:
        return self.predict(sparse(texts, self.features, cache))


def chosen(docs: np.ndarray, inside: dict[str, np.ndarray], n: int, pos: dict[str, int]) -> np.ndarray:
    """Features by how much more often they stand in texts of one class; docs and inside count texts, all and positive."""
    there = np.flatnonzero(docs >= LEAST_DOCS)
    docs, worth = docs[there].astype(float), np.zeros(len(there))
    for name, have in inside.items():
        if 0 < pos[name] < n:
            have, share = have[there].astype(float), docs / n
            spread = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / pos[name] + 1 / (n - pos[name])))
            worth = np.maximum(worth, np.abs(have / pos[name] - (docs - have) / (n - pos[name])) / spread)
    best = np.argsort(-worth, kind="stable")[:FEATURES]
    return there[best[worth[best] > 0]]


def fit_chain(texts: pa.Array, labels: dict[str, np.ndarray], folds: int = FOLDS) -> Chain:
    """Chooses the features, then fits the categories in order; labels: 0 or 1 by category. Equal texts are in one fold,
    and a fold's own texts have no part in choosing the features of the models that predict it."""
    n = len(texts)
    runs = [(k, compact(texts.slice(k, RUN_ROWS))) for k in range(0, n, RUN_ROWS)]
    fold = np.fromiter((zlib.crc32(t.as_py().encode()) % folds for _, part in runs for t in part), np.int64, n)
    count = np.min_scalar_type(n)  # two bytes for up to 65,535 texts
    docs = np.zeros((folds, HASHED), count)
    inside = {k: np.zeros((folds, HASHED), count) for k in labels}
    for first, part in runs:
        rows = sparse(part, None, {})
        own = fold[first : first + len(part)]
        for f in range(folds):
            there = rows.take(np.flatnonzero(own == f))
            docs[f] += np.bincount(there.index, minlength=HASHED).astype(count)
            for name, y in labels.items():
                there = rows.take(np.flatnonzero((own == f) & (y[first : first + len(part)] == 1)))
                inside[name][f] += np.bincount(there.index, minlength=HASHED).astype(count)

    def choice(used: np.ndarray) -> np.ndarray:
        at = np.isin(fold, used)
        return chosen(docs[used].sum(axis=0, dtype=count), {k: v[used].sum(axis=0, dtype=count) for k, v in inside.items()}, int(at.sum()), {k: int(y[at].sum()) for k, y in labels.items()})

    best = choice(np.arange(folds))
    others = [choice(np.flatnonzero(np.arange(folds) != f)) for f in range(folds)]
    del docs, inside
    # Features of all models, those of the chain first.
    known = {f: k for k, f in enumerate(dict.fromkeys(np.concatenate([best, *others]).tolist()))}
    cache: dict[str, tuple[int, ...]] = {}
    parts = [sparse(part, known, cache) for _, part in runs]
    starts = np.r_[0, np.cumsum([len(p.index) for p in parts], dtype=np.int64)]
    bounds = np.concatenate([np.zeros(1, np.int64), *[p.bounds[1:] + a for p, a in zip(parts, starts, strict=False)]])
    rows = Rows(bounds, np.concatenate([np.zeros(0, np.int64), *[p.index for p in parts]]), np.concatenate([np.zeros(0), *[p.value for p in parts]]))
    width = max(1, len(known))

    def only(features: np.ndarray) -> Rows:
        mask = np.zeros(width, bool)
        mask[[known[f] for f in features.tolist()]] = True
        stays = mask[rows.index]
        return Rows(np.r_[0, np.cumsum(stays)][rows.bounds], rows.index[stays], rows.value[stays])

    chain = Chain(list(labels), {f: k for k, f in enumerate(best.tolist())})
    whole = only(best)
    before = np.zeros((n, 0))
    for y in labels.values():
        y = y.astype(float)
        model = fit_linear(whole, before, y, width)
        chain.models.append(Linear(model.weights[: max(1, len(best))], model.before, model.bias))
        out = np.zeros(n)
        for k in range(folds):
            train, test = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(train) and len(test):
                seen = only(others[k])
                out[test] = fit_linear(seen.take(train), before[train], y[train], width).predict(seen.take(test), before[test])
        chain.thresholds.append(best_threshold(out, y))
        before = np.c_[before, out]
    return chain


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Chain:
    """Fits the chain on at most train_rows labelled rows of docs."""
    wanted = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    kinds = categories()
    wanted = wanted.select(F.col("doc_id").alias("_id"), *[c.cast("int").alias(f"_{k}") for k, c in kinds.items()]).orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    # At most train_rows rows of an id and a few bits.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(wanted), "_id").orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text")).limit(train_rows)
    found = rows.toArrow()
    known = {k: pc.fill_null(found[f"_{k}"], 0).to_numpy() for k in kinds}
    texts = pc.fill_null(found["_text"].combine_chunks().cast(pa.large_string()), "")
    del found
    chain = fit_chain(texts, known)
    del texts
    give_back()
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", reject: float | None = None) -> DataFrame:
    """One row per row of docs: doc_id, a probability for each category, and toxic."""
    names = [f"p_{k}" for k in chain.names]
    at = chain.names.index("toxic")
    reject = chain.thresholds[at] if reject is None else reject

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in slices(batches, text_col):
            p = chain.predict_texts(texts_of(batch, text_col), cache)
            if len(cache) > CACHED:
                cache.clear()
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(p[:, at] >= reject)], names=["doc_id", *names, "toxic"])

    return docs.select(id_col, text_col).mapInArrow(released(run), f"doc_id long, {', '.join(f'{n} double' for n in names)}, toxic boolean")


def clean(docs: DataFrame, chain: Chain, text_col: str = "text", reject: float | None = None) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns."""
    at = chain.names.index("toxic")
    reject = chain.thresholds[at] if reject is None else reject

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in slices(batches, text_col):
            p = chain.predict_texts(texts_of(batch, text_col), cache)
            if len(cache) > CACHED:
                cache.clear()
            yield batch.filter(pa.array(p[:, at] < reject))

    return docs.mapInArrow(released(run), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))


__all__ = ["Chain", "Linear", "Rows", "categories", "clean", "fit_chain", "learn", "op6_toxicity", "score", "sparse"]
