"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A window is a string of LENGTH bytes within a text. Every byte that a window covers is removed if the window's string
starts anywhere else too, in the same text or another one.

1. Anchors. Of the rolling hashes of the ANCHOR-byte strings in a window the least one (the leftmost of equal ones) is
   the window's anchor. Equal windows have equal anchors, so windows meet by anchor. Neighbouring windows with one anchor
   form a segment. Equal segments are counted, not compared; anchors that occur once are done.
2. Anchors with one distinct segment that occurs several times: all its windows are repeated.
3. The distinct segments of the other anchors are joined into a text with separators, and its suffix order (by the first
   512 bytes) gives the Burrows-Wheeler transform. Breadth-first, intervals of strings are extended backward, string
   length by string length; each new end of an interval sets the common prefix of its two neighbours to that length.
   The search stops at LENGTH: what is still unset is a common prefix of at least LENGTH, and the runs of such places
   are the groups of equal windows. A group counts as often as its segments occur.

Passages. The same search over words in place of bytes: a window is a string of PASSAGE words (A-Z as a-z; 64-bit hashes),
and it counts if it occurs in another row too. It finds the passages of over 50 words that have fewer than LENGTH bytes.
They are counted beside; the bytes that are removed follow LENGTH alone.

Bounds: an anchor with more than BLOCK segment bytes is searched as pairs of blocks, so no task holds an unbounded group.
Texts are read in bounded batches; equal texts share one row of windows. Words of a long text are searched in pieces.

Defined results: null counts as empty; texts shorter than LENGTH keep all, and those of fewer than PASSAGE words have no
passage; repeated rows make each other repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import hashed_words, keep, mix, slices, small, table, texts_of

LENGTH, ANCHOR = 400, 200
#: Words of a passage and of its anchors.
PASSAGE, WORD_ANCHOR = 51, 10
#: Windows of words whose anchors are chosen at once.
PIECE = 1 << 22
#: Bytes of segments that are transformed at once, and of a block of a hot anchor.
CHUNK, BLOCK = 1 << 20, 4 << 20
#: Share of all rows above which an anchor is hot.
HOT = 1000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
LETTER = mix(np.arange(1, 257, dtype=np.uint64))
PLACE = np.uint64((1 << 24) - 1)


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all strings of k bytes, or of k words that are given by their hashes."""
    n = len(data)
    data = LETTER[data] if data.dtype == np.uint8 else data
    power = np.cumprod(np.full(n, BASE, np.uint64)) if n else np.zeros(0, np.uint64)
    back = np.cumprod(np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)) if n else power
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(data * back)]
    return mix((total[k:] - total[:-k]) * power[: n - k + 1])


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each run of w values."""
    n = len(x)
    pad = (-n) % w
    full = np.r_[x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def segments(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window start of each segment of a text."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = rolling(data, anchor)
    least = sliding_least((h & ~PLACE) | (np.arange(len(h), dtype=np.uint64) & PLACE), length - anchor + 1)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    place = (least[first] & PLACE).astype(np.int64)
    place += (first - place) // (1 << 24) * (1 << 24) + np.where((first - place) % (1 << 24) > 0, 1 << 24, 0) if len(h) > 1 << 24 else 0
    return h[place], first, np.r_[first[1:], len(least)] - 1


def word_segments(bounds: np.ndarray, words: np.ndarray, length: int = PASSAGE, anchor: int = WORD_ANCHOR, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """Number of the text, anchor hash, first and last window start (a word number) and content hash of each segment.

    bounds (n + 1) part the hashed words by text.
    """
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found = []
    for low in range(0, len(words) - length + 1, piece):
        w, t = words[low : low + piece + length - 1], text[low : low + piece + length - 1]
        h, whole = rolling(w, anchor), rolling(w, length)
        least = sliding_least((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), length - anchor + 1)
        inside = t[: len(least)] == t[length - 1 :]
        new = np.r_[True, (least[1:] != least[:-1]) | (t[1 : len(least)] != t[: len(least) - 1])]
        first, last = np.flatnonzero(inside & new), np.flatnonzero(inside & np.r_[new[1:] | ~inside[1:], True])
        place = (least[first] & PLACE).astype(np.int64)
        found.append((t[first], h[place], place + low, first + low, last + low, whole[first], whole[last]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2, np.zeros(0, np.uint64)
    own, h, place, first, last, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
    # A segment that two pieces share is one again.
    one = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][: len(place)])
    final = np.r_[one[1:], len(place)][: len(one)] - 1
    own, h, first, last, begin, end = own[one], h[one], first[one], last[final], begin[one], end[final]
    # The first and the last window meet, as both hold the anchor: they and their distance tell the contents.
    return own, h, first - bounds[own], last - bounds[own], mix(mix(begin + (last - first).astype(np.uint64)) ^ end)


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first `depth` symbols (at least), and the place of each suffix, by prefix doubling."""
    n = len(text)
    h = 8 if text.dtype == np.uint8 else 1
    padded = np.r_[text, np.zeros(h, text.dtype)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(h):
        key = key << np.uint64(8) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]])
    while h < depth and rank[order[-1]] < n - 1:
        pair = rank * (n + 1)
        pair[: n - h] += rank[h:] + 1 if h < n else 0
        order = np.argsort(pair, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, pair[order][1:] != pair[order][:-1]])
        h *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def long_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for each place whether it shares `length` symbols with the place before it (separators aside).

    text holds bytes or numbered words, so shifted that 0 is the separator.
    """
    n, letters = len(text), int(text.max()) + 1
    order, place = suffix_order(text, length + 1)
    before = np.where(order > 0, order - 1, n - 1)
    bwt, step = text[before], place[before]
    common = np.full(n + 1, -1, np.int32)
    common[[0, n]] = 0
    low, wide = np.zeros(1, np.int64), np.array([n], np.int64)
    for level in range(length):
        ends = np.cumsum(wide)
        at = np.arange(ends[-1]) + np.repeat(low - (ends - wide), wide)
        c = bwt[at].astype(np.int64)
        key = np.repeat(np.arange(len(low)), wide) * letters + c
        if level:  # a separator may only end a string
            real = c > 0
            at, key = at[real], key[real]
        if not len(at):
            break
        order_ = np.argsort(key, kind="stable")
        key = key[order_]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        child = np.minimum.reduceat(step[at[order_]], first)
        width = np.diff(np.r_[first, len(key)])
        new = common[child + width] < 0
        if level == 0:
            new |= child + width == n
        low, wide = child[new], width[new]
        common[low + wide] = np.where(common[low + wide] < 0, level, common[low + wide])
        if not len(low):
            break
    return order, common[:n] < 0


def joined_text(parts: list[bytes], starts: np.ndarray, n: int) -> np.ndarray:
    """The bytes of all parts, each followed by the separator 0."""
    text = np.zeros(n, np.uint16)
    for p, a in zip(parts, starts.tolist(), strict=True):
        text[a : a + len(p)] = np.frombuffer(p, np.uint8).astype(np.uint16) + 1
    # 256 byte values and the separator: bytes that no segment has make room for it.
    present = np.unique(text)
    if len(present) > 256:
        # Every byte value occurs; invalid in UTF-8, whose texts lack 0xC0, 0xC1 and 0xF5 to 0xFF.
        raise ValueError("segments are not UTF-8")
    code = np.zeros(257, np.uint8)
    code[present] = np.arange(len(present))
    return code[text]


def repeated_windows(parts: list, weight: np.ndarray, length: int = LENGTH, texts: np.ndarray | None = None) -> list[np.ndarray]:
    """For each segment the starts of its windows that occur at least twice, segments counting `weight` times.

    With `texts`, the text of each segment, parts are arrays of hashed words, and a window counts if it occurs in two texts
    or in a segment of weight 2 and more, which stands for a segment of several texts.
    """
    size = np.array([len(p) for p in parts], np.int64)
    starts = np.r_[0, np.cumsum(size + 1)][:-1]
    n = int((size + 1).sum())
    owner = np.repeat(np.arange(len(parts)), size + 1)
    inside = np.arange(n) - starts[owner]
    if texts is None:
        text = joined_text(parts, starts, n)
    else:
        text = np.zeros(n, np.int64)
        text[inside < size[owner]] = np.unique(np.concatenate(parts), return_inverse=True)[1] + 1
    order, joined = long_prefixes(text, length)
    valid = (inside + length <= size[owner])[order]
    group = np.cumsum(~joined) - 1
    if texts is None:
        enough = np.bincount(group, weight[owner[order]] * valid) >= 2
    else:
        first, of, span = np.flatnonzero(~joined), texts[owner[order]], np.iinfo(np.int64)
        least, most = (f.reduceat(np.where(valid, of, none), first) for f, none in ((np.minimum, span.max), (np.maximum, span.min)))
        enough = (least < most) | (np.maximum.reduceat(weight[owner[order]] * valid, first) >= 2)
    hit = order[valid & enough[group]]
    hit.sort()
    cut = np.searchsorted(hit, starts)
    return [hit[a:b] - s for a, b, s in zip(cut.tolist(), [*cut[1:].tolist(), len(hit)], starts.tolist(), strict=True)]


def raw(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if x is None else x for x in batch.column("text").cast(pa.large_binary()).to_pylist()]


def as_runs(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of neighbouring window starts."""
    if not len(starts):
        return [], []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist()


def covered(windows: list, length: int) -> tuple[int, int]:
    """Maximal runs that windows cover, and the words in them."""
    if not windows:
        return 0, 0
    a = np.array([w["a"] for w in windows], np.int64)
    order = np.argsort(a)
    a, end = a[order], np.maximum.accumulate(np.array([w["b"] for w in windows], np.int64)[order]) + length
    new = np.flatnonzero(np.r_[True, a[1:] > end[:-1]])
    return len(new), int((end[np.r_[new[1:], len(a)] - 1] - a[new]).sum())


def repeats(rows: DataFrame, length: int, anchor: int, chunk: int, block: int, words: bool = False) -> DataFrame:
    """Runs of repeated windows of the texts in rows (text, t1, t2): t1, t2, first and last window start (a, b).

    By bytes, windows that occur twice; by words, windows that occur in two rows, runs of copies as often as these occur.
    """
    unit = 8 if words else 1
    shape = "anchor long, t1 long, t2 long, a long, b long, seg long"

    def anchors(batches):
        for batch in slices(batches, "text"):
            t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
            cols = [[] for _ in range(5)]
            seg: list[int] = []
            for k, data in enumerate(raw(batch)):
                h, a, b = segments(np.frombuffer(data, np.uint8), length, anchor)
                seg += [xxhash.xxh3_64_intdigest(data[x : y + length]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                for c, v in zip(cols, (h.view(np.int64), np.full(len(h), t1[k]), np.full(len(h), t2[k]), a, b), strict=True):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(c)) for c in cols], pa.array(np.array(seg, np.uint64).view(np.int64))], names=["anchor", "t1", "t2", "a", "b", "seg"])

    def word_anchors(batches):
        for batch in slices(batches, "text"):
            t1, t2, r = (batch.column(k).to_numpy() for k in ("t1", "t2", "r"))
            k, h, a, b, seg = word_segments(*hashed_words(texts_of(batch)), length, anchor)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), t1[k], t2[k], a, b, seg.view(np.int64), r[k])], names=["anchor", "t1", "t2", "a", "b", "seg", "r"])

    if words:  # rows are numbered in the run that stores them
        found = keep(rows.select("text", "t1", "t2", F.monotonically_increasing_id().alias("r")).mapInArrow(word_anchors, shape + ", r long"), "anchors")
    else:
        found = rows.select("text", "t1", "t2").mapInArrow(anchors, shape)
        found = keep(found.groupBy("anchor", "t1", "t2", "a", "b", "seg").agg(F.count(F.lit(1)).alias("m")), "anchors")
    several = F.min("r") < F.max("r")
    groups = found.groupBy("anchor").agg((several if words else F.sum("m") >= 2).alias("again"), (F.min("seg") == F.max("seg")).alias("plain"), (F.sum(F.col("b") - F.col("a") + length) * unit).alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = keep(groups.filter("again").drop("again"), "groups")
    # Anchors with over a HOT-th of all rows: fewer than HOT, so their facts are broadcast and their rows stay where they are.
    is_hot = F.col("n") * HOT > found.count()
    hot = F.broadcast(groups.filter(is_hot).drop("n"))
    cold = found.join(hot.select("anchor"), "anchor", "left_anti").join(groups.filter(~is_hot).drop("n"), "anchor")
    open_ = keep(found.join(hot, "anchor").unionByName(cold), "open")
    plain = open_.filter("plain").select("t1", "t2", "a", "b")

    # Bytes of one occurrence of each distinct segment of the anchors left.
    hard = open_.filter("NOT plain")
    weights = hard.groupBy("anchor", "seg").agg((F.when(several, 2).otherwise(1).cast("long") if words else F.sum("m")).alias("m"), F.min(F.struct("t1", "t2", "a", "b")).alias("x"), F.max("bytes").alias("bytes"))
    weights = weights.select("anchor", "seg", "m", "bytes", "x.*")
    wanted = keep(weights.groupBy("t1", "t2").agg(F.collect_list(F.struct("anchor", "seg", "m", "bytes", "a", "b")).alias("segs")), "wanted")
    few = small(wanted.select(F.explode("segs")), 500_000)
    one = rows.select("text", "t1", "t2").join(F.broadcast(wanted) if few else wanted, ["t1", "t2"])

    def cut(batches):
        for batch in slices(batches, "text"):
            out = {k: [] for k in ("anchor", "seg", "m", "bytes", "t1", "part")}
            if words:
                bounds, h = hashed_words(texts_of(batch))
                units = [h[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            else:
                units = raw(batch)
            for data, t1, segs in zip(units, batch.column("t1").to_pylist(), batch.column("segs").to_pylist(), strict=True):
                for s in segs:
                    for k in ("anchor", "seg", "m", "bytes"):
                        out[k].append(s[k])
                    out["t1"].append(t1)
                    part = data[s["a"] : s["b"] + length]
                    out["part"].append(part.tobytes() if words else part)
            yield pa.RecordBatch.from_arrays([*[pa.array(out[k], pa.int64()) for k in ("anchor", "seg", "m", "bytes", "t1")], pa.array(out["part"], pa.binary())], names=list(out))

    parts = one.select("text", "t1", "segs").mapInArrow(cut, "anchor long, seg long, m long, bytes long, t1 long, part binary")
    # Copies of a text give the same segments; the first of each is taken.
    parts = parts.groupBy("anchor", "seg").agg(F.any_value("m").alias("m"), F.any_value("bytes").alias("bytes"), F.any_value("t1").alias("t1"), F.any_value("part").alias("part"))
    # Blocks of a hot anchor meet in pairs; nearly all anchors have one block.
    parts = parts.withColumn("blocks", F.ceil(F.col("bytes") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("seg"), F.col("blocks")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = parts.select("anchor", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "seg", "m", "t1", "part")
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(n_parts, "anchor", "x", "y").sortWithinPartitions("anchor", "x", "y")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush():
            # Anchors share a transform: windows of different anchors differ, so they never meet in a group.
            pieces = [np.frombuffer(p, np.uint64) if words else p for *_, p in held]
            runs = repeated_windows(pieces, np.array([m for _, _, m, _, _ in held]), length, np.array([t for _, _, _, t, _ in held]) if words else None)
            out = {"anchor": [], "seg": [], "first": [], "last": []}
            for (a, s, *_), starts in zip(held, runs, strict=True):
                f, t = as_runs(starts)
                out["anchor"] += [a] * len(f)
                out["seg"] += [s] * len(f)
                out["first"] += f
                out["last"] += t
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in ("anchor", "x", "y", "seg", "m", "t1", "part")], strict=True):
                key = row[:3]
                if held and (size > chunk and key != last or last is not None and key[0] == last[0] and key != last):
                    yield flush()
                    held, size = [], 0
                held.append((row[0], *row[3:]))
                size, last = size + len(row[6]), key
        if held:
            yield flush()

    hits = parts.mapInArrow(expand, "anchor long, seg long, first long, last long").distinct()
    hard = hard.join(hits, ["anchor", "seg"]).select("t1", "t2", (F.col("a") + F.col("first")).alias("a"), (F.col("a") + F.col("last")).alias("b"))
    return plain.unionByName(hard)


def removed(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, block: int = BLOCK, passage: int = 0, word_anchor: int = WORD_ANCHOR) -> DataFrame:
    """One row per row of docs: doc_id, kept (the bytes left, as binary), n_bytes, n_removed, n_spans.

    With `passage`: also n_passages, the maximal runs of words that strings of `passage` words of other rows cover, and
    n_passage_words, the words in them; these take no bytes away.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    runs = repeats(rows, length, anchor, chunk, block).withColumn("words", F.lit(False))
    if passage:
        runs = runs.unionByName(repeats(rows, passage, min(word_anchor, passage), chunk, block, words=True).withColumn("words", F.lit(True)))
    by = [F.collect_set(F.when(w, F.struct("a", "b"))).alias(name) for name, w in (("runs", ~F.col("words")), ("passages", F.col("words")))]
    runs = keep(runs.groupBy("t1", "t2").agg(*by), "runs")
    few = small(runs.select(F.explode(F.concat("runs", "passages"))), 500_000)
    joined = rows.join(F.broadcast(runs) if few else runs, ["t1", "t2"], "left").select("doc_id", "text", "runs", "passages")

    def drop(batches):
        for batch in slices(batches, "text"):
            kept, size, gone, spans = [], [], [], []
            for data, windows in zip(raw(batch), batch.column("runs").to_pylist(), strict=True):
                size.append(len(data))
                if not windows:
                    kept.append(data)
                    gone.append(0)
                    spans.append(0)
                    continue
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, [w["a"] for w in windows], 1)
                np.add.at(edge, [w["b"] + length for w in windows], -1)
                over = np.cumsum(edge)[:-1] > 0
                kept.append(np.frombuffer(data, np.uint8)[~over].tobytes())
                gone.append(int(over.sum()))
                spans.append(int((over & ~np.r_[False, over[:-1]]).sum()))
            out = {"doc_id": batch.column("doc_id"), "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64())}
            if passage:
                both = [covered(w, passage) for w in batch.column("passages").to_pylist()]
                out |= {k: pa.array([x[i] for x in both], pa.int64()) for i, k in enumerate(("n_passages", "n_passage_words"))}
            yield pa.RecordBatch.from_pydict(out)

    return joined.mapInArrow(drop, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long" + ", n_passages long, n_passage_words long" * bool(passage))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the digest the text that is left, where bytes of a character that was cut stand as U+FFFD, and the passages of
    over 50 words that other documents have too, whatever their bytes."""
    rows = removed(table(spark, sf_dir, "documents"), passage=PASSAGE)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"), "n_passages", "n_passage_words")


__all__ = ["long_prefixes", "op5_suffix_dedup", "removed", "repeated_windows", "repeats", "segments", "word_segments"]
