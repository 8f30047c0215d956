"""Periodic run detection after Kolpakov and Kucherov: every maximal repetition of words in each text.

A run is a stretch of consecutive words in which words q apart are identical, q being its smallest period, that is at
least `least` words and two periods long and that no neighbouring word extends. Texts are searched as follows.

1. A run of L >= least words has L - q >= least / 2 matches in a row, so each of its words lies in a sequence of
   GRAM = least / 2 words that occurs twice in the text. Stretches covered by such sequences (64-bit hashes; a collision
   only adds a stretch) are searched, the other words lie in no run.
2. The stretch is cut into Lempel-Ziv factors: from each place on, the longest sequence that starts earlier too, found by
   walking a suffix automaton whose states know their first occurrence.
3. Runs that cross or touch the start b of a factor, and end in it, are found after Main: common prefixes and suffixes of
   the words around b for each period (Z functions). Such a run reaches less than two factors before and one factor
   length to the left, so all windows together are linear in the stretch.
4. Runs that lie inside a factor are copies of runs inside its earlier occurrence.

Scale: one pass over the texts, no shuffle; a text is the unit of work, its arrays (five of 4 bytes a state, two states a
word of a searched stretch) are all that a task holds besides the batch.

Defined results: null and empty texts have no words and no runs; words are case-sensitive; a null id stays null, repeated
rows are searched again, other columns are not read.
"""

from __future__ import annotations

from array import array
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import BLANKS, doc_of, mix, released, slices, table, texts_of

#: Words of the shortest run.
LEAST = 12


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (n + 1) of the words of each text, and the code of each word within the batch."""
    parts = pc.ascii_split_whitespace(texts)
    bounds = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    real = codes != empty
    return np.r_[0, np.cumsum(real)][bounds - bounds[0]], codes[real]


def stretches(bounds: np.ndarray, codes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The places (start, end) where runs can lie: covered by sequences of words that occur twice in one text."""
    gram = (least + 1) // 2
    n = len(codes) - gram + 1
    if n < 2:
        return []
    doc, x = doc_of(bounds), mix(codes + 1)
    h = doc[:n].astype(np.uint64)
    for k in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : n + k]
    at = np.flatnonzero(doc[:n] == doc[gram - 1 :])
    at = at[np.argsort(h[at])]
    same = h[at[1:]] == h[at[:-1]]
    at = at[np.r_[same, False] | np.r_[False, same]] if len(at) else at
    change = np.bincount(at, minlength=len(codes) + 1) - np.bincount(at + gram, minlength=len(codes) + 1)
    covered = np.cumsum(change)[:-1] > 0
    new = np.r_[True, doc[1:] != doc[:-1]]
    first = np.flatnonzero(covered & (new | ~np.r_[False, covered[:-1]]))
    end = np.flatnonzero(covered & np.r_[new[1:] | ~covered[1:], True]) + 1
    return [(a, b) for a, b in zip(first.tolist(), end.tolist(), strict=True) if b - a >= least]


class Automaton:
    """The suffix automaton of a sequence; each state knows where its first occurrence ends.

    The first transition of a state stands in two arrays, further ones in a dict of those states that branch.
    """

    def __init__(self, w: list[int]):
        self.first, self.letter, self.target, self.more = array("i", [-1]), array("q", [-1]), array("i", [-1]), {}
        link, length, last = array("i", [-1]), array("i", [0]), 0
        for i, c in enumerate(w):
            new = self.state(i, -1, -1)
            link.append(0)
            length.append(length[last] + 1)
            p, last = last, new
            while p >= 0 and (q := self.step(p, c)) < 0:
                self.put(p, c, new)
                p = link[p]
            if p < 0:
                continue
            if length[q] != length[p] + 1:
                copy = self.state(self.first[q], self.letter[q], self.target[q])
                if q in self.more:
                    self.more[copy] = dict(self.more[q])
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and self.step(p, c) == q:
                    self.put(p, c, copy)
                    p = link[p]
                link[q], q = copy, copy
            link[new] = q

    def state(self, first: int, letter: int, target: int) -> int:
        self.first.append(first)
        self.letter.append(letter)
        self.target.append(target)
        return len(self.first) - 1

    def step(self, p: int, c: int) -> int:
        if self.letter[p] == c:
            return self.target[p]
        further = self.more.get(p)
        return -1 if further is None else further.get(c, -1)

    def put(self, p: int, c: int, q: int) -> None:
        if self.letter[p] in (-1, c):
            self.letter[p], self.target[p] = c, q
        else:
            self.more.setdefault(p, {})[c] = q


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """The Lempel-Ziv factors: start, length, and start of an earlier occurrence (-1 for a new letter)."""
    known, out, i, n = Automaton(w), [], 0, len(w)
    while i < n:
        state, size, source = 0, 0, -1
        while i + size < n:
            state = known.step(state, w[i + size])
            if known.first[state] - size >= i:
                break
            source = known.first[state] - size
            size += 1
        out.append((i, max(size, 1), source))
        i += max(size, 1)
    return out


def common_prefixes(x: list[int]) -> list[int]:
    """For each place of x the length of the longest common prefix of x and of what starts there (the Z function)."""
    n = len(x)
    z, low, high = [n] + [0] * (n - 1) if n else [], 0, 0
    for i in range(1, n):
        k = min(high - i, z[i - low]) if i < high else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def crossing(w: list[int], before: int, b: int, after: int, least: int) -> dict[tuple[int, int], int]:
    """Runs (start, end) -> period that start at b or before it and end in (b, after], or end at b and start after `before`;
    before, b and after are successive starts of factors."""
    found: dict[tuple[int, int], int] = {}
    low = max(0, b - 2 * (b - before) - (after - b) - 1)
    left, right = w[low:b], w[b : after + 1]
    n, m = len(left), len(right)
    if n + m < least:
        return found
    back = left[::-1]

    # Periods that fit between b and the run's end.
    ahead = common_prefixes(right)
    behind = common_prefixes([*back, -1, *right[::-1], *back])
    for q in range(1, min(m, after - b) + 1):
        p, s = ahead[q] if q < m else 0, behind[n + 1 + m - q]
        if s + p >= q and s + q + p >= least and b + q + p <= after:
            found.setdefault((b - s, b + q + p), q)
    # Periods that fit between the run's start and b.
    behind = common_prefixes(back)
    ahead = common_prefixes([*right, -1, *left, *right])
    for q in range(1, min(n, after - before) + 1):
        s, p = behind[q] if q < n else 0, ahead[m + 1 + n - q]
        if s + p >= q and s + q + p >= least and b + p <= after and (p or b - q - s > before):
            key = (b - q - s, b + p)
            found[key] = min(q, found.get(key, q))
    return found


def runs(w: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs of w of at least `least` letters: start, length, period, in order of start and period."""
    parts = factors(w)
    starting: dict[int, list[tuple[int, int]]] = {}
    for k in range(1, len(parts) + 1):
        b, size, source = parts[k] if k < len(parts) else (len(w), 0, -1)
        for (start, end), q in crossing(w, parts[k - 1][0], b, b + size, least).items():
            starting.setdefault(start, []).append((end, q))
        if size < least + 2:
            continue
        shift = b - source
        for start in range(source + 1, source + size - least):
            for end, q in starting.get(start, ()):
                if end < source + size:
                    starting.setdefault(start + shift, []).append((end + shift, q))
    return sorted((start, end - start, q) for start, ends in starting.items() for end, q in ends)


def searched(texts: pa.Array, least: int) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
    """Bounds of the words of each text, and the runs of each text."""
    bounds, codes = word_codes(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for a, b in stretches(bounds, codes, least):
        k = int(np.searchsorted(bounds, a, "right")) - 1
        shift = a - int(bounds[k])
        out[k] += [(start + shift, length, q) for start, length, q in runs(codes[a:b].tolist(), least)]
    return bounds, out


def collapsed(text: str, found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by single spaces."""
    words = text.encode().split()
    if found:
        kept = np.ones(len(words), bool)
        for start, length, q in found:
            kept[start + q : start + length] = False
        words = list(compress(words, kept.tolist()))
    return b" ".join(words)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text without repetitions."""

    def run(batches):
        for batch in slices(batches, "text"):
            texts = texts_of(batch)
            bounds, found = searched(texts, least)
            ends = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
            flat = np.array([r for x in found for r in x], np.int64).reshape(-1, 3)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"]))
            left = pa.array([collapsed(t, x) for t, x in zip(texts.to_pylist(), found, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), lists, left], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The query's texts: in one of ten documents the words from a place on repeat with a period, both drawn from the id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, f"{BLANKS}+"), lambda w: w != "")

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    # The words of a planted text are made once, by the transform over a list of one.
    made = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise(F.lit(""))), 1)
    return F.when(h % 10 == 0, made).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = find(docs).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * -F.col("best.l") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
