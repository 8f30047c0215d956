"""Language-model scoring with Katz backoff.

Grams of up to ORDER words are discounted by Good-Turing (counts 1 to TOP) and back off, with weights that make every
history's distribution sum to one exactly, to grams shorter by a word and at last to unigrams smoothed by ADD (one more
place for all unknown words). Words and the end of each text are tokens; a text begins with the history "start".

A slice is a run of about SLICE text bytes. Its distinct words are counted where it is read; requests with these counts
go, packed, to the bucket of each word's 64-bit hash, which holds that part of the unigram table, adds up the counts of
all slices, numbers its words and answers each slice. Then, order by order, the distinct (history, word) pairs of a slice
go to buckets likewise; a history is named by the number of the gram one word shorter, a word by its number, so nothing
but the first words is known by hashes. Buckets hold the tables (history, word, count) and, by history, the count, the
types by count and the lower orders' mass, from which the backoff weight follows. A gram travels once a slice however
often it occurs. A pair's bucket is its history's; histories with over HOT tokens are hot and spread over all buckets by
word: what the buckets know of one is summed by history, and there are at most TOTAL / HOT of them. Buckets grow in
number with the slices; only totals and the hot histories' facts reach the driver. The recursion is evaluated for each
distinct gram of a slice and summed over its tokens.

Requests and answers are rows of (slice, bucket, payload); beyond a point each holds few pairs, as in a plain shuffle.
`tables` gives the tables as columns.

Defined results: a null text is empty and has one token, its end; a null id counts as the empty text when it is hashed;
repeated rows are learnt from and scored each; without training rows every word is unknown; a history never seen in
training leaves the word to the lower order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import doc_of, hashed_words, keep, mix, slices, table, texts_of

ADD, TOP, SLICE = 0.1, 5, 10 << 20
#: Order of the registered query. Distinct trigrams of the test tables nearly equal their tokens: a third order would
#: travel about as a second copy of the corpus.
ORDER = 2
#: Training tokens after a history from which on it is hot, and the most hot histories.
HOT, MOST_HOT = 1 << 18, 1 << 16
START, END = 0, np.uint64(0x454E44)
SCHEMA = "slice long, bucket long, payload binary"
#: Rows that aren't an answer to a slice: a bucket's totals, what it knows of a hot history, its table.
TOTALS, HEAT, TABLE = -1, -2, -3


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another: type, length, and their bytes by place value, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
        data = pa.compress(planes, "zstd", asbytes=True) if planes else b""
        out.append(a.dtype.str.encode().ljust(4) + np.array([len(a), len(data)], "<i8").tobytes() + data)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind = np.dtype(data[at : at + 4].decode().strip())
        n, size = np.frombuffer(data, "<i8", 2, at + 4).tolist()
        raw = pa.decompress(data[at + 20 : at + 20 + size], n * kind.itemsize, "zstd", asbytes=True) if n else b""
        out.append(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n) if n else np.zeros(0, kind))
        at += 20 + size
    return out


def rows_of(slice_: list[int], bucket: list[int], payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slice_, pa.int64()), pa.array(bucket, pa.int64()), pa.array(payload, pa.binary())], names=["slice", "bucket", "payload"])


def held_out(doc_id: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for d in doc_id], bool)


def read_slices(size: int):
    """Slices: ids, held-out flags, bounds, codes of tokens (frequent ones small), and hashes of the codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", size):
            bounds, words = hashed_words(texts_of(batch))
            ids, codes = np.unique(words, return_inverse=True)
            ids = np.r_[ids, END]
            ends = bounds[1:] + np.arange(1, len(bounds))
            tokens = np.insert(codes, bounds[1:], len(ids) - 1)
            count = np.bincount(tokens, minlength=len(ids))
            order = np.argsort(-count, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            doc = batch.column("doc_id").to_pylist()
            missing = np.array([d is None for d in doc], np.uint8)
            payload = pack(np.array([d or 0 for d in doc], np.int64), missing, held_out(doc).astype(np.uint8), np.r_[0, ends], place[tokens].astype(np.uint32), ids[order])
            yield rows_of([part << 32 | n], [-1], [payload])
            n += 1

    return run


def training(bounds: np.ndarray, held: np.ndarray) -> np.ndarray:
    return ~held.astype(bool)[doc_of(bounds)]


def by_bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket and key, the buckets met, and where each starts (n + 1)."""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((key, bucket))
    met, first = np.unique(bucket[order], return_index=True)
    return order, met, np.r_[first, len(key)]


def ask_words(buckets: int):
    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("slice").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                _, _, held, bounds, codes, ids = unpack(data)
                count = np.bincount(codes[training(bounds, held)], minlength=len(ids))
                order, met, first = by_bucket(ids, buckets)
                yield rows_of([name] * len(met), met.tolist(), [pack(ids[order[a:b]], count[order[a:b]].astype(np.uint32)) for a, b in zip(first[:-1], first[1:], strict=True)])

    return run


def numbers(count: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Numbers of a bucket's grams, frequent ones small, that no other bucket gives."""
    out = np.empty(len(count), np.int64)
    out[np.argsort(-count, kind="stable")] = np.arange(len(count)) * buckets + bucket
    return out


def add_words(buckets: int):
    """One bucket of the unigram table: counts of all slices and numbers, and for each slice those it asked for."""

    def run(rows: pa.Table) -> pa.Table:
        names, bucket = rows["slice"].to_pylist(), rows["bucket"][0].as_py()
        asked = [unpack(x) for x in rows["payload"].to_pylist()]
        _, back = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        total = np.bincount(back, np.concatenate([a[1] for a in asked])).astype(np.int64)
        number = numbers(total, bucket, buckets)
        at = np.r_[0, np.cumsum([len(a[0]) for a in asked])]
        answers = [pack(total[back[x:y]], number[back[x:y]]) for x, y in zip(at[:-1], at[1:], strict=True)]
        return pa.Table.from_batches([rows_of([*names, TOTALS], [bucket] * (len(names) + 1), [*answers, pack(np.array([total.sum(), (total > 0).sum()], np.int64))])])

    return run


def unigram(count: np.ndarray, n: int, v: int) -> np.ndarray:
    return (count + ADD) / (n + ADD * (v + 1))


class Model:
    """What all slices share: buckets of each order, tokens, words, and for each order from 2 on its discounts and its hot
    histories (sorted) with their facts (a row for each fact)."""

    def __init__(self, buckets: int, n: int, v: int, hot: int):
        self.buckets, self.n, self.v = buckets, n, v
        self.least = max(hot, n // MOST_HOT)
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


class Grams:
    """The distinct grams of one order in a slice: history (as code of a gram one shorter, plus 1) and word by code, how
    often each is trained on, and the gram of each token; then count, number and probability, from the answers."""

    def __init__(self, before: "Grams | None", bounds: np.ndarray, words: np.ndarray, train: np.ndarray, number: np.ndarray):
        if before is None:
            self.back, self.word = words, np.arange(len(number))
            return
        last = np.r_[0, before.back[:-1] + 1]
        last[bounds[:-1]] = START
        pair, first, self.back = np.unique(last * (len(number) + 1) + words, return_index=True, return_inverse=True)
        self.history, self.word = pair // (len(number) + 1), pair % (len(number) + 1)
        self.trained = np.bincount(self.back, train, len(pair)).astype(np.int64)
        self.lower = before.p[before.back[first]]
        self.h, self.w = np.r_[START, before.number + 1][self.history], number[self.word]
        self.follows = np.r_[np.iinfo(np.int64).max, before.count][self.history]  # "start" is always hot

    def dealt(self, model: Model) -> tuple[np.ndarray, ...]:
        """Which are of hot histories; an order by bucket, history and word; the buckets met, and where each starts (n + 1)."""
        hot = self.follows > model.least
        h = self.h.astype(np.uint64)
        bucket = (mix(np.where(hot, mix(h + np.uint64(1)) + self.w.astype(np.uint64), h)) % np.uint64(model.buckets)).astype(np.int64)
        order = np.lexsort((self.w, self.h, bucket))
        met, first = np.unique(bucket[order], return_index=True)
        return hot, order, met, np.r_[first, len(order)]

    def answered(self, model: Model, place: int, answers: dict[int, bytes]) -> None:
        """Sets count, number and p. place: of the order, 0 for bigrams."""
        discount, hot_h, hot_facts = model.orders[place]
        hot, order, met, first = self.dealt(model)
        self.count, self.number, self.p = np.empty(len(self.w), np.int64), np.empty(len(self.w), np.int64), np.empty(len(self.w))
        for b, x, y in zip(met.tolist(), first[:-1], first[1:], strict=True):
            at = order[x:y]
            count, self.number[at], *known = unpack(answers[b])
            own, k = np.unique(self.h[at], return_inverse=True)
            warm = np.zeros(len(own), bool)
            warm[k] = hot[at]
            facts = np.zeros((TOP + 3, len(own)))
            facts[:, ~warm] = known
            if warm.any():
                facts[:, warm] = hot_facts[:, np.searchsorted(hot_h, own[warm])]
            self.count[at] = count
            self.p[at] = katz(self.count[at], self.lower[at], facts[:, k], discount)


def slice_of(data: bytes, model: Model, answers: dict[int, dict[int, bytes]]) -> tuple:
    """doc, missing, held, bounds, unigrams and the grams of the highest order that the answers reach, one higher without
    answers."""
    doc, missing, held, bounds, codes, ids = unpack(data)
    codes, train = codes.astype(np.int64), training(bounds, held)
    order, met, first = by_bucket(ids, model.buckets)
    count, number = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    for b, x, y in zip(met.tolist(), first[:-1], first[1:], strict=True):
        count[order[x:y]], number[order[x:y]] = unpack(answers[1][b])
    words = grams = Grams(None, bounds, codes, train, number)
    words.count, words.number, words.p = count, number, unigram(count, model.n, model.v)
    for k in range(len(model.orders)):
        grams = Grams(grams, bounds, codes, train, number)
        grams.answered(model, k, answers[k + 2])
    return doc, missing, held, bounds, codes, train, words, grams


def answers_of(right: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for kind, bucket, payload in zip(right["kind"].to_pylist(), right["bucket"].to_pylist(), right["payload"].to_pylist(), strict=True):
        out.setdefault(kind, {})[bucket] = payload
    return out


def ask_pairs(model: Model):
    """The pairs of the next order: histories, whether hot, pairs of each; words, counts, and the lower order's probability
    as a code of its distinct values."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, answers = [rows_of([], [], [])], answers_of(right)
        for name, data in zip(left["slice"].to_pylist(), left["payload"].to_pylist(), strict=True):
            _, _, _, bounds, codes, train, words, grams = slice_of(data, model, answers)
            grams = Grams(grams, bounds, codes, train, words.number)
            hot, order, met, first = grams.dealt(model)
            payloads = []
            for a, b in zip(first[:-1], first[1:], strict=True):
                at = order[a:b]
                own, start, runs = np.unique(grams.h[at], return_index=True, return_counts=True)
                values, code = np.unique(grams.lower[at], return_inverse=True)
                payloads.append(pack(own, hot[at][start].astype(np.uint8), runs.astype(np.uint32), grams.w[at], grams.trained[at].astype(np.uint32), values, code.astype(np.uint32)))
            out.append(rows_of([name] * len(met), met.tolist(), payloads))
        return pa.Table.from_batches(out)

    return run


def add_pairs(buckets: int, last: bool, with_table: bool):
    """One bucket of a pair table. Facts of a history: its count, its types by count up to TOP, the mass of larger counts,
    and the lower order's mass of its words."""

    def run(rows: pa.Table) -> pa.Table:
        names, bucket = rows["slice"].to_pylist(), rows["bucket"][0].as_py()
        asked = [unpack(x) for x in rows["payload"].to_pylist()]
        h = np.concatenate([np.repeat(a[0], a[2]) for a in asked])
        w, count = (np.concatenate([a[k] for a in asked]) for k in (3, 4))
        lower = np.concatenate([a[5][a[6]] for a in asked])
        order = np.lexsort((w, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])]
        kind = np.empty(len(h), np.int64)
        kind[order] = np.cumsum(new) - 1
        r = np.bincount(kind, count).astype(np.int64)
        number = np.zeros(len(r), np.int64) if last else numbers(r, bucket, buckets)
        first = order[new]
        own, hk = np.unique(h[first], return_inverse=True)
        facts = [np.bincount(hk, r, len(own)).astype(np.int64), *[np.bincount(hk[r == k], minlength=len(own)).astype(np.int64) for k in range(1, TOP + 1)], np.bincount(hk, r * (r > TOP), len(own)).astype(np.int64), np.bincount(hk, lower[first] * (r > 0), len(own))]
        at = np.r_[0, np.cumsum([len(a[3]) for a in asked])]
        hot = np.zeros(len(own), bool)
        answers = []
        for a, x, y in zip(asked, at[:-1], at[1:], strict=True):
            k = np.searchsorted(own, a[0])
            warm = a[1].astype(bool)
            hot[k[warm]] = True
            answers.append(pack(r[kind[x:y]].astype(np.uint32), number[kind[x:y]], *[f[k[~warm]] for f in facts]))
        heat = np.flatnonzero(hot).tolist()
        out = [
            rows_of([*names, TOTALS], [bucket] * (len(names) + 1), [*answers, pack(np.array([(r == k).sum() for k in range(1, TOP + 2)], np.int64))]),
            rows_of([HEAT] * len(heat), own[heat].tolist(), [np.array([float(f[k]) for f in facts]).tobytes() for k in heat]),
        ]
        if with_table:
            out.append(rows_of([TABLE], [bucket], [pack(h[first][r > 0], w[first][r > 0], r[r > 0], number[r > 0])]))
        return pa.Table.from_batches(out)

    return run


def add_heat(rows: pa.Table) -> pa.Table:
    """Facts of one hot history, from all buckets."""
    facts = np.sum([np.frombuffer(x) for x in rows["payload"].to_pylist()], axis=0)
    return pa.Table.from_batches([rows_of([HEAT], [rows["bucket"][0].as_py()], [facts.tobytes()])])


def discounts(types: np.ndarray) -> np.ndarray:
    """Good-Turing discount of the counts 0 to TOP (index 0 unused); types[r - 1]: bigrams seen r times.

    Where the counts of counts give no discount between 0 and 1, half a count is taken off instead.
    """
    out = np.ones(TOP + 1)
    n = np.r_[0, types].astype(float)
    cut = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 1.0
    for r in range(1, TOP + 1):
        d = (((r + 1) * n[r + 1] / n[r] / r) - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def katz(r, lower, facts, discount):
    """P(word | history): discounted if the gram is seen, else the backoff weight times the lower order's; facts of the history."""
    ch, mass, lower_seen = facts[0], facts[TOP + 1], facts[TOP + 2]
    kept = sum(facts[k] * discount[k] * k for k in range(1, TOP + 1)) + mass
    whole = np.where(kept >= ch, ch + 1, ch)  # a history whose counts are all large sets one count aside
    weight = np.where(ch > 0, (1 - kept / np.maximum(whole, 1)) / np.maximum(1 - lower_seen, 1e-300), 1.0)
    seen = r * np.where(r <= TOP, discount[np.minimum(r, TOP)], 1.0) / np.maximum(whole, 1)
    return np.where(r > 0, seen, weight * lower)


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_slices(model: Model):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, answers = [], answers_of(right)
        for data in left["payload"].to_pylist():
            doc, missing, held, bounds, codes, _, words, grams = slice_of(data, model, answers)
            starts = bounds[:-1]
            add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
            columns = [
                pa.array(doc, mask=missing.astype(bool)), pa.array(held.astype(bool)), pa.array(np.diff(bounds)), pa.array(add((words.count[codes] > 0).astype(np.int64))),
                pa.array(np.full(len(doc), model.n)), pa.array(add(np.log10(words.p)[codes])), pa.array(add(np.log10(grams.p)[grams.back])),
            ]
            out.append(pa.RecordBatch.from_arrays(columns, names=SCORES.names))
        return pa.Table.from_batches(out) if out else SCORES.empty_table()

    return run


def learned(docs: DataFrame, order: int, id_col: str, text_col: str, hot: int, with_table: bool) -> tuple[DataFrame, DataFrame, Model, list[DataFrame]]:
    """The slices, the answers to them, the model, and what the buckets of each order from 2 on gave."""
    read = keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(read_slices(SLICE), SCHEMA), "slices")
    # About a million distinct pairs a bucket.
    buckets = max(16, 2 * read.count())
    words = keep(read.mapInArrow(ask_words(buckets), SCHEMA).groupBy("bucket").applyInArrow(add_words(buckets), SCHEMA), "words")
    # One row of totals per bucket.
    totals = [unpack(r.payload)[0] for r in words.filter(F.col("slice") == TOTALS).select("payload").collect()]
    model = Model(buckets, *(int(x) for x in (np.sum(totals, axis=0) if totals else (0, 0))), hot)
    answers = words.filter("slice >= 0").withColumn("kind", F.lit(1))
    levels = []
    for k in range(2, order + 1):
        asked = read.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(ask_pairs(model), SCHEMA)
        pairs = keep(asked.groupBy("bucket").applyInArrow(add_pairs(buckets, k == order, with_table), SCHEMA), "pairs")
        totals = [unpack(r.payload)[0] for r in pairs.filter(F.col("slice") == TOTALS).select("payload").collect()]
        heat = pairs.filter(F.col("slice") == HEAT).groupBy("bucket").applyInArrow(add_heat, SCHEMA).collect()  # MOST_HOT rows at most, or N / HOT
        heat = sorted((r.bucket, np.frombuffer(r.payload)) for r in heat)
        facts = np.array([f for _, f in heat]).T if heat else np.zeros((TOP + 3, 0))
        model.orders.append((discounts(np.sum(totals, axis=0) if totals else np.zeros(TOP + 1, np.int64)), np.array([h for h, _ in heat], np.int64), facts))
        answers = answers.unionByName(pairs.filter("slice >= 0").withColumn("kind", F.lit(k)))
        levels.append(pairs)
    return read, answers, model, levels


def tables(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> list[DataFrame]:
    """For each order from 2 on, the rows (history, word, count, number) of its trained grams. Histories and words are
    numbers of shorter grams, a history's plus one; history 0 is the start of a text."""

    def run(batches):
        for batch in batches:
            for data in batch.column("payload").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in unpack(data)], names=["history", "word", "count", "number"])

    levels = learned(docs, order, id_col, text_col, hot, True)[3]
    return [x.filter(F.col("slice") == TABLE).select("payload").mapInArrow(run, "history long, word long, count long, number long") for x in levels]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    read, answers, model, _ = learned(docs, order, id_col, text_col, hot, False)
    return read.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(score_slices(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


__all__ = ["discounts", "katz", "op10_katz", "pack", "score", "tables", "unigram", "unpack"]
