"""Secret scans: fixed patterns, and formats learnt by grammar inference.

Labelled credentials are the distinct values that the fixed patterns match, ordinary runs all other runs of credential
characters; both are of all documents and whole. For each kind their prefix tree is folded into a probabilistic
automaton: two states are merged when the frequencies of ending and of each next symbol class are statistically
compatible (Hoeffding bound) all the way down. Another automaton learns half of the ordinary runs. Every run of
credential characters in every text is then a candidate, scored by the log-likelihood ratio of the best format against
the ordinary runs; those over a threshold become added spans of the kind `format`, unless spans of fixed patterns cover
them whole. The threshold is set on all ordinary runs of the other half.

Scale: Spark counts the states of the prefix trees, the passages of all values through the merged automata, and the rates
of the ordinary runs by bins of 1 / BINS bit. The driver merges the states that at least two values and 1 / SHARE of a kind's
values reach within DEEPEST symbols: fewer than SHARE a symbol. What leads to rarer states leads to the first state, as the
test can't tell them apart; their values count like all others in the automaton's frequencies.

Defined results: null counts as the empty text, which has no span; texts of any length are scanned whole; offsets are
code points; repeated rows are scanned each; without labelled credentials there are no added spans.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import LENGTH, keep, mix, powers, slices, table, texts_of

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_HINT = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ASSIGN_LEAST, RUN_LEAST = 12, 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % RUN_LEAST)
HEX_LEAST = 16

#: States that the driver merges: reached by 1 / SHARE of a kind's values and within DEEPEST symbols; bins of a bit.
SHARE, DEEPEST, BINS = 1000, 512, 1024
#: Letters whose steps in the prefix tree a worker counts at once.
STEPS = 1 << 18
#: Confidence of the merge test, share of ordinary runs that may pass the threshold, least gain over ordinary runs in bits.
ALPHA, PASS, LEAST_BITS = 0.05, 0.001, 12.0

RUN_BYTES = np.zeros(256, bool)
RUN_BYTES[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
HEX_BYTES = np.zeros(256, bool)
HEX_BYTES[[*b"0123456789abcdef"]] = True
#: Symbol classes: a-f, other small letters, A-F, other capitals, digits, and each sign for itself.
CLASS = np.zeros(256, np.int64)
for _n, _letters in enumerate((b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"+", b"/", b"_", b".", b"=", b"-")):
    CLASS[[*_letters]] = _n
CLASS_SIZE = np.array([6, 20, 6, 20, 10, 1, 1, 1, 1, 1, 1])
CLASSES = len(CLASS_SIZE)


class PrefixTree:
    """Counts of ends and of next classes by state; states are merged in place."""

    def __init__(self, values: list[str]):
        self.ends, self.next, self.count = [0], [{}], [{}]
        for value in values:
            state = 0
            for c in CLASS[np.frombuffer(value.encode("latin-1", "replace"), np.uint8)].tolist():
                self.count[state][c] = self.count[state].get(c, 0) + 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.ends)
                    self.ends.append(0)
                    self.next.append({})
                    self.count.append({})
                state = self.next[state][c]
            self.ends[state] += 1

    @classmethod
    def of(cls, nodes: dict[int, dict[int, tuple[int, int]]], root: int) -> PrefixTree:
        """The tree of counted nodes, each with (next node, count) by class, the class CLASSES for ends; nodes may be missing."""
        tree = cls([])
        state, todo = {root: 0}, [root]
        for key in todo:
            own = state[key]
            for c, (below, n) in sorted(nodes.get(key, {}).items()):
                if c == CLASSES:
                    tree.ends[own] = n
                    continue
                tree.count[own][c] = n
                if below in nodes:
                    state[below] = tree.next[own][c] = len(tree.ends)
                    tree.ends.append(0)
                    tree.next.append({})
                    tree.count.append({})
                    todo.append(below)
        return tree

    def seen(self, state: int) -> int:
        return self.ends[state] + sum(self.count[state].values())

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen(a), self.seen(b)
            if not n or not m:
                continue
            most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if most >= 1:  # too few values to tell, here and below
                continue
            if abs(self.ends[a] / n - self.ends[b] / m) > most:
                return False
            for c in {*self.count[a], *self.count[b]}:
                if abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) > most:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the tree below b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c not in self.next[b]:
                    continue
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]


@dataclass
class Automaton:
    """A probabilistic automaton as tables; the last state is where unseen classes lead."""

    step: np.ndarray
    log: np.ndarray
    end: np.ndarray

    def score(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log-likelihood (base 2) of each value; codes holds the classes of all values."""
        length = np.diff(bounds)
        order = np.argsort(-length, kind="stable")
        starts, length = bounds[:-1][order], length[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order))
        for k in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -k, side="left"))
            c, s = codes[starts[:live] + k], state[:live]
            total[:live] += self.log[s, c]
            state[:live] = self.step[s, c]
        total += self.end[state]
        out = np.empty_like(total)
        out[order] = total
        return out


def merged(tree: PrefixTree, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Merges compatible states of the prefix tree, in breadth-first order: next states by class, -1 for none, and counts by
    class and of ends."""
    kept = [0]
    fringe = sorted(tree.next[0].items())
    parents = [(0, c) for c, _ in fringe]
    while parents:
        parent, c = parents.pop(0)
        state = tree.next[parent][c]
        if state in kept:
            continue
        for other in kept:
            if tree.compatible(other, state, alpha):
                tree.next[parent][c] = other
                tree.fold(other, state)
                break
        else:
            kept.append(state)
        queue = {(s, x) for s in kept for x, t in tree.next[s].items() if t not in kept}
        parents = sorted(queue, key=lambda p: (kept.index(p[0]), p[1]))
    place = {s: k for k, s in enumerate(kept)}
    step = np.array([[place[tree.next[s][c]] if c in tree.next[s] else -1 for c in range(CLASSES)] for s in kept])
    return step, np.array([[*(tree.count[s].get(c, 0) for c in range(CLASSES)), tree.ends[s]] for s in kept])


def automaton(step: np.ndarray, counts: np.ndarray) -> Automaton:
    """The automaton of next states and counts: classes that no value had lead out, those without a state of their own to the first."""
    sink = len(step)
    total = counts.sum(axis=1) + 0.01 * (CLASSES + 1)
    out = math.log2(1 / (CLASS_SIZE.sum() + 1))
    log = np.vstack([np.log2((counts[:, :CLASSES] + 0.01) / total[:, None] / CLASS_SIZE), np.full((1, CLASSES), out)])
    end = np.r_[np.log2((counts[:, CLASSES] + 0.01) / total), out]
    there = np.where(counts[:, :CLASSES] > 0, np.maximum(step, 0), sink)
    return Automaton(np.vstack([there, np.full((1, CLASSES), sink)]), log, end)


def infer(values: list[str], alpha: float = ALPHA) -> Automaton:
    return automaton(*merged(PrefixTree(values), alpha))


def passages(step: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often the values pass each state by each class, and end there; classes without a next state lead to the first."""
    counts = np.zeros((len(step), CLASSES + 1), np.int64)
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    starts, length = bounds[:-1][order], length[order]
    state = np.zeros(len(order), np.int64)
    for k in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -k, side="left"))
        c, s = codes[starts[:live] + k], state[:live]
        np.add.at(counts, (s, c), 1)
        state[:live] = np.maximum(step[s, c], 0)
    np.add.at(counts, (state, CLASSES), 1)
    return counts


#: Hashes of the classes, and the tree's root, the hash of no symbols.
SYMBOL = mix(np.arange(1, CLASSES + 1, dtype=np.uint64))
ROOT = int(mix(np.zeros(1, np.uint64)).view(np.int64)[0])


def prefixes(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, class, next node, times) of the steps of all values in their prefix tree, to DEEPEST symbols; nodes are hashes."""
    up, down = powers(len(codes) + 1)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(SYMBOL[codes] * down[:-1])]
    length = np.diff(bounds)
    kept = np.minimum(length + 1, DEEPEST + 1)
    at = np.cumsum(kept) - kept
    depth = np.arange(int(kept.sum())) - np.repeat(at, kept)
    start, size = np.repeat(bounds[:-1], kept), np.repeat(length, kept)

    def node(d):
        return mix((total[start + d] - total[start]) * up[start] + d.astype(np.uint64) * LENGTH).view(np.int64)

    ends = depth == size
    symbol = np.where(ends, CLASSES, codes[np.minimum(start + depth, len(codes) - 1)])
    own, below = node(depth), np.where(ends, 0, node(np.minimum(depth + 1, size)))
    # Node and class make one key: a bijection of the node's hash, and a small number.
    _, first, times = np.unique(own.view(np.uint64) * LENGTH + symbol.astype(np.uint64), return_index=True, return_counts=True)
    return own[first], symbol[first], below[first], times


@dataclass
class Formats:
    """Automata of the kinds and of ordinary runs, and the gain (bits, bits a symbol) that a secret must exceed."""

    kinds: list[Automaton]
    ordinary: Automaton
    least: float = LEAST_BITS
    rate: float = 0.0

    def gains(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        best = np.max([a.score(codes, bounds) for a in self.kinds], axis=0)
        return best - self.ordinary.score(codes, bounds)

    def chosen(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        gain = self.gains(codes, bounds)
        return (gain >= self.least) & (gain >= self.rate * np.diff(bounds))


def as_codes(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer("".join(values).encode("latin-1"), np.uint8)
    return CLASS[flat], np.r_[0, np.cumsum([len(v) for v in values], dtype=np.int64)]


def fit(labelled: dict[str, list[str]], ordinary: list[str], alpha: float = ALPHA) -> Formats | None:
    """Formats of values at hand; learn() counts those of all documents on Spark."""
    kinds = [infer(v, alpha) for _, v in sorted(labelled.items()) if v]
    if not kinds or not ordinary:
        return None
    half = ordinary[::2]
    formats = Formats(kinds, infer(half, alpha))
    held = ordinary[1::2] or half
    codes, bounds = as_codes(held)
    rates = np.sort(formats.gains(codes, bounds) / np.diff(bounds))
    formats.rate = max(0.0, float(rates[min(len(rates) - 1, math.ceil(len(rates) * (1 - PASS)))]))
    return formats


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """(start, kind, end, secret) of the fixed patterns, by start and kind."""
    out = [(m.start(), "assign", m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), "access", m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each text starts (n + 1)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(flat: np.ndarray, at: np.ndarray, kind: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of bytes of a kind within texts, of `least` bytes and more: text, start, end."""
    inside = kind[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[at] = True
    first = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    last = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    long = last - first >= least
    return np.searchsorted(at, first[long], side="right") - 1, first[long], last[long]


def worth(texts: pa.Array) -> np.ndarray:
    """Which texts may have base spans."""
    flat, at = flat_bytes(texts)
    out = pc.match_substring_regex(texts, ASSIGN_HINT).to_numpy(zero_copy_only=False) | pc.match_substring(texts, "AKIA").to_numpy(zero_copy_only=False)
    if len(flat):
        out[runs(flat, at, HEX_BYTES, HEX_LEAST)[0]] = True
    return out


def scan(texts: pa.Array, formats: Formats | None) -> list[tuple[list, list]]:
    """For each text its base spans and all its spans, as (start, kind, end)."""
    flat, at = flat_bytes(texts)
    out: list[tuple[list, list]] = [([], [])] * len(texts)
    for k in np.flatnonzero(worth(texts)).tolist():
        base = [(a, kind, b) for a, kind, b, _ in base_spans(texts[k].as_py())]
        out[k] = (base, base)
    if formats is None or not len(flat):
        return out
    text, first, last = runs(flat, at, RUN_BYTES, RUN_LEAST)
    if not len(first):
        return out
    length = last - first
    bounds = np.r_[0, np.cumsum(length)]
    codes = CLASS[flat[np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], length)]]
    chosen = np.flatnonzero(formats.chosen(codes, bounds))
    if len(chosen):
        points = np.r_[0, np.cumsum((flat & 0xC0) != 0x80)]
        for j in chosen.tolist():
            k = int(text[j])
            a, b = (int(points[x] - points[at[k]]) for x in (first[j], last[j]))
            base, spans = out[k]
            # Base spans, in order of their start, report the run if they leave no part of it.
            to = a
            for x, _, y in base:
                to = max(to, y) if x <= to else to
            if to < b:
                out[k] = (base, sorted([*spans, (a, "format", b)], key=lambda x: (x[0], KINDS.index(x[1]))))
    return out


def sampled(key: Column, total: int, sample: int) -> Column:
    """Whether a hash of the key puts a row among `sample` of `total` rows, in expectation; false for a null key."""
    if sample >= total:
        return key.isNotNull()
    return F.coalesce(F.shiftrightunsigned(F.xxhash64(F.lit(7), key), 1) < sample * (1 << 63) // total, F.lit(False)) & key.isNotNull()


def values_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct (kind, value) of docs: credentials by kind, and ordinary runs, kind "", of rows marked `ordinary`."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = texts_of(batch, text_col)
            flat, at = flat_bytes(texts)
            found: set[tuple[str, str]] = set()
            based = {}
            for k in np.flatnonzero(worth(texts)).tolist():
                based[k] = base_spans(texts[k].as_py())
                found |= {(kind, secret) for _, kind, _, secret in based[k]}
            if len(flat):
                points = np.r_[0, np.cumsum((flat & 0xC0) != 0x80)]
                text, first, last = runs(flat, at, RUN_BYTES, RUN_LEAST)
                wanted = batch.column("ordinary").to_numpy(zero_copy_only=False)[text]
                for k, i, j in zip(text[wanted].tolist(), first[wanted].tolist(), last[wanted].tolist(), strict=True):
                    base = based.get(k)
                    if base:
                        a, b = int(points[i] - points[at[k]]), int(points[j] - points[at[k]])
                        if any(x < b and a < y for x, _, y, _ in base):
                            continue
                    found.add(("", flat[i:j].tobytes().decode("ascii")))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["kind", "value"])

    return docs.select(text_col, "ordinary").mapInArrow(values, "kind string, value string").distinct()


def by_kind(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Of values (kind, value) those of each kind, as codes and bounds."""
    kinds = batch.column("kind")
    for kind in pc.unique(kinds).to_pylist():
        yield kind, *as_codes(batch.column("value").filter(pc.equal(kinds, kind)).to_pylist())


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int | None = None, sample_values: int | None = None, sample_letters: int | None = None, alpha: float = ALPHA) -> Formats | None:
    """Automata and threshold from all credentials and ordinary runs of all documents. A caller may ask for less: ordinary runs of
    about `sample_docs` documents, `sample_values` values and `sample_letters` letters a kind."""
    ordinary = F.lit(True) if sample_docs is None else sampled(F.col(id_col), docs.count(), sample_docs)
    found = values_of(docs.select(text_col, ordinary.alias("ordinary")), text_col)
    if sample_values is not None or sample_letters is not None:
        near = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
        found = found.withColumn("n", F.row_number().over(near)).withColumn("letters", F.sum(F.char_length("value")).over(near))
        found = found.filter((F.col("n") <= (sample_values or 1 << 62)) & (F.col("letters") <= (sample_letters or 1 << 62))).drop("n", "letters")
    # Ordinary runs: half teach the automaton, half set the threshold.
    half = F.when(F.pmod(F.xxhash64(F.lit(3), F.col("value")), F.lit(2)) == 0, "ordinary").otherwise("held")
    found = keep(found.withColumn("kind", F.when(F.col("kind") == "", half).otherwise(F.col("kind"))), "values")
    total = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    if not total.keys() - {"ordinary", "held"} or not total.keys() & {"ordinary", "held"}:
        return None
    # Of very few runs all may lie in one half.
    teach = "ordinary" if "ordinary" in total else "held"
    rated = "held" if "held" in total else teach
    kinds = sorted(total.keys() - {"ordinary", "held"})

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "value", STEPS):
            for kind, codes, bounds in by_kind(batch):
                rows = prefixes(codes, bounds)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows[0]), pa.string()), *map(pa.array, rows)], names=["kind", "node", "symbol", "below", "n"])

    taught = found.filter(F.col("kind").isin([*kinds, teach]))
    edges = taught.mapInArrow(steps, "kind string, node long, symbol long, below long, n long").groupBy("kind", "node", "symbol", "below").agg(F.sum("n").alias("n"))
    least = F.element_at(F.create_map(*[F.lit(x) for k in (*kinds, teach) for x in (k, max(2, -(-total[k] // SHARE)))]), F.col("kind"))
    nodes = edges.groupBy("kind", "node").agg(F.sum("n").alias("seen"), F.collect_list(F.struct("symbol", "below", "n")).alias("edges")).filter((F.col("seen") >= least) | (F.col("node") == ROOT))
    trees: dict[str, dict[int, dict[int, tuple[int, int]]]] = {k: {} for k in (*kinds, teach)}
    for r in nodes.collect():
        trees[r["kind"]][r["node"]] = {e["symbol"]: (e["below"], e["n"]) for e in r["edges"]}
    step = {k: merged(PrefixTree.of(t, ROOT), alpha)[0] for k, t in trees.items()}

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {k: np.zeros((len(s), CLASSES + 1), np.int64) for k, s in step.items()}
        for batch in slices(batches, "value"):
            for kind, codes, bounds in by_kind(batch):
                counts[kind] += passages(step[kind], codes, bounds)
        for kind, n in counts.items():
            state, symbol = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(state), pa.string()), pa.array(state), pa.array(symbol), pa.array(n[state, symbol])], names=["kind", "state", "symbol", "n"])

    counts = {k: np.zeros((len(s), CLASSES + 1), np.int64) for k, s in step.items()}
    for r in taught.mapInArrow(passed, "kind string, state long, symbol long, n long").groupBy("kind", "state", "symbol").agg(F.sum("n").alias("n")).collect():
        counts[r["kind"]][r["state"], r["symbol"]] = r["n"]
    formats = Formats([automaton(step[k], counts[k]) for k in kinds], automaton(step[teach], counts[teach]))

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "value"):
            codes, bounds = as_codes(batch.column("value").to_pylist())
            bins, n = np.unique(np.floor(formats.gains(codes, bounds) / np.diff(bounds) * BINS).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n)], names=["bin", "n"])

    # Rates lie within some bits, so the bins are few at any number of runs.
    binned = found.filter(F.col("kind") == rated).mapInArrow(rates, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
    place = min(total[rated] - 1, math.ceil(total[rated] * (1 - PASS)))
    at = int(np.searchsorted(np.cumsum([r["n"] for r in binned]), place, side="right"))
    formats.rate = max(0.0, (binned[at]["bin"] + 1) / BINS)
    return formats


def find(docs: DataFrame, formats: Formats | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base and spans, arrays of (start, kind, end)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            found = scan(texts_of(batch, text_col), formats)
            as_rows = lambda spans: [{"start": a, "kind": k, "end": b} for a, k, b in spans]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([as_rows(x) for x, _ in found], kind), pa.array([as_rows(y) for _, y in found], kind)], names=["doc_id", "base", "spans"])

    spans = "array<struct<start: long, kind: string, end: long>>"
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id long, base {spans}, spans {spans}")


def digests(found: DataFrame) -> DataFrame:
    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(find(docs, learn(docs)))


__all__ = ["Automaton", "Formats", "PrefixTree", "base_spans", "digests", "find", "fit", "infer", "learn", "op8_secrets", "scan"]
