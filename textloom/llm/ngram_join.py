"""N-gram Jaccard self-join by signature trees, with the components of its links.

A text's set holds the hashes (64 bits) of its distinct shingles of k lower-cased words; a text with fewer words has one
shingle, one without words none. Two sets link when 100 * |x & y| >= PERCENT * |x | y|.

1. Texts with equal sets are one class; copies never meet as pairs.
2. Shingles have one order: by how often their slot of a sketch (SLOTS counters, filled from all texts) was met, on a
   logarithmic scale, ties by hash. Two linked sets share one of the first |x| - ceil(t |x|) + 1 shingles of each
   (prefix filter; it is exact in any order), so classes meet in the buckets of these shingles. Common lines come late
   in the order, so buckets stay small. Shingles that only one class has in its prefix are dropped.
3. In a bucket classes stand in signature trees, one for each width of bitmap: nodes hold OR-combined bitmaps of the
   members' tokens and ranges of their sizes. A dual traversal goes down pairs of nodes and prunes those whose greatest
   possible overlap (common bits, plus tokens that share a bit) is below the least that their sizes need, and those whose
   members are in one component already. A bucket of at most FAN classes is one node; many such are compared at once.
   Before signatures travel, classes leave whose bucket holds none of a fitting size in another component.
4. Classes with a partner that the traversal leaves fetch their sets, read from the texts again. The same groups are then
   searched with the sets at hand: a surviving pair of two components is compared exactly and, if it links, joins them.
   So a group gives out at most as many links as it has classes, and never a candidate.
5. Two rounds look at two buckets of each class only, in blocks, and join most near copies into components. The last one
   searches every bucket that still holds several components, whole; two classes that meet in several buckets of up
   to ONCE classes are compared in the first of these only.

Bounds: groups are blocks of a bucket (first rounds) or pairs of blocks (last round), filled by hash and so many that a
block holds about BLOCK classes and TOKENS shingles; a pair of blocks is never cut. Only ids, hashes and bitmaps travel,
and the sets of classes that a bitmap lets through. The sketch is the one thing that reaches the driver: SLOTS counters.

Defined results: null and empty texts have no shingle and link with nothing, not even each other; a null id never names
a component unless no other id is there; repeated rows are in one component; an empty table gives an empty result; a
text of any length is one set, which one task holds whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import fresh, hashed_words, keep, mix, released, row_key, slices, small, table, texts_of, without
from textloom.llm.components import components

#: Counters of the sketch, and of a row in which they travel.
SLOTS, PIECE = 1 << 20, 1 << 14
#: Least and most bits of a signature, children of a tree node.
LEAST_BITS, MOST_BITS, FAN = 512, 1 << 16, 8
#: Bits a token, at least, of the signatures that travel, and of those made where the sets are at hand.
NARROW, WIDE = 3, 12
#: Classes and bytes of a block of the first rounds; classes and shingles of a block of the last one.
NEAR, NEAR_BYTES, BLOCK, TOKENS = 1024, 16 << 20, 8192, 4 << 20
#: Most classes of a bucket whose pairs are listed, so that each is compared in one bucket.
ONCE = 64
#: No limit: the group is whole.
WHOLE = 1 << 60


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    bounds, h = hashed_words(texts)
    n = max(0, len(h) - k + 1)
    s = np.zeros(n, np.uint64)
    for j, c in enumerate(mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)):
        s += h[j : j + n] * c
    s = mix(s)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(s[a : b - k + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                whole = mix(whole + x)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(20)).astype(np.int64) & (SLOTS - 1)


def sketch(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """For each slot twice the binary logarithm of how many shingles of all texts fell into it, as a byte."""

    def count(batches):
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in slices([batch], text_col):
                sets = shingle_sets(texts_of(part, text_col), k)
                seen += np.bincount(slots(np.concatenate(sets)), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS // PIECE)), pa.array([x.astype("<i8").tobytes() for x in seen.reshape(-1, PIECE)], pa.binary())], names=["piece", "seen"])

    def add(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column("piece").to_pylist(), batch.column("seen").to_pylist(), strict=True):
                seen[piece] = seen.get(piece, 0) + np.frombuffer(data, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([x.tobytes() for x in seen.values()], pa.binary())], names=["piece", "seen"])

    shape = "piece long, seen binary"
    each = docs.select(text_col).mapInArrow(released(count), shape)
    total = np.zeros((SLOTS // PIECE, PIECE), np.int64)
    for row in each.repartition("piece").mapInArrow(add, shape).collect():  # SLOTS counters in all
        total[row.piece] = np.frombuffer(row.seen, "<i8")
    return np.minimum(255, 2 * np.log2(1 + total.ravel())).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def prefix(tokens: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a sorted set in the common order."""
    return tokens[np.argsort(level[slots(tokens)], kind="stable")[: prefix_length(len(tokens), percent)]]


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def width_of(n: int, bits: int) -> int:
    """Bits of the signature of n tokens: `bits` to twice as many a token, or as many as are allowed."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (n * bits).bit_length()))


def signature(tokens: np.ndarray, bits: int = NARROW) -> bytes:
    """Bit t mod width for each token t; a wider signature folds into a narrower one by OR of its halves."""
    width = width_of(len(tokens), bits)
    out = np.zeros(width, np.uint8)
    out[(tokens % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


class Tree:
    """Levels of a signature tree; level 0 holds the members. Members should be in an order that keeps like ones together."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, group: np.ndarray | None = None):
        count = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        group = np.arange(len(size)) if group is None else group
        # Bitmap, least and greatest size, most tokens that share a bit, least and greatest component.
        self.levels = [(bits, size, size, size - count, group, group)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, slack, first, last = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children at `level` of nodes one level up: number of the node in the list, and child."""
        first = node * FAN
        count = np.minimum(FAN, len(self.levels[level][0]) - first)
        index = np.repeat(np.arange(len(node)), count)
        start = np.r_[0, np.cumsum(count)][:-1]
        return index, first[index] + np.arange(len(index)) - start[index]


def feasible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether node pairs may hold a link: the greatest possible overlap reaches the least one that is needed."""
    apart = (a[4][i] != b[4][j]) | (a[5][i] != b[5][j]) | (a[4][i] != a[5][i])
    ok = np.flatnonzero(apart & (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i]))
    x, y = i[ok], j[ok]
    common = np.empty(len(x), np.int64)
    for k in range(0, len(x), 65_536):
        common[k : k + 65_536] = np.bitwise_count(a[0][x[k : k + 65_536]] & b[0][y[k : k + 65_536]]).sum(axis=1, dtype=np.int64)
    need = -(-percent * (a[1][x] + b[1][y]) // (100 + percent))
    out = np.zeros(len(i), bool)
    out[ok] = np.minimum(np.minimum(a[2][x], b[2][y]), common + np.minimum(a[3][x], b[3][y])) >= need
    return out


def traverse(x: Tree, y: Tree, percent: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members that may link, in batches; same: x and y are one tree, and pairs i < j are wanted."""
    depth = max(len(x.levels), len(y.levels)) - 1
    todo = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, i, j = todo.pop()
        ok = feasible(x.levels[min(level, len(x.levels) - 1)], i, y.levels[min(level, len(y.levels) - 1)], j, percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if level == 0:
            if same:
                i, j = i[i < j], j[i < j]
            yield i, j
            continue
        if level < len(x.levels):
            at, i = x.children(level - 1, i)
            j = j[at]
        if level < len(y.levels):
            at, j = y.children(level - 1, j)
            i = i[at]
        if same:
            i, j = i[i <= j], j[i <= j]
        for k in range(0, len(i), 1 << 18):
            todo.append((level - 1, i[k : k + (1 << 18)], j[k : k + (1 << 18)]))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def find(parent: list[int], a: int) -> int:
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    return a


def fold(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


def candidates(size: np.ndarray, bits: list[bytes], percent: int, group: np.ndarray | None = None, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members that may link, in batches; with `side`, one of each side only.

    Members are held by the width of their bitmaps; against a narrower tree a wider one is folded.
    """
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    if side is not None:
        parts = [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
    else:
        parts = [np.arange(len(size))]

    def trees(rows):
        out = {}
        for w in np.unique(width[rows]).tolist():
            at = rows[width[rows] == w]
            flat = np.frombuffer(b"".join([bits[k] for k in at.tolist()]), np.uint64).reshape(len(at), w // 8)
            out[w] = (at, flat)
        return out

    def tree(rows, flat):
        return Tree(size[rows], flat, rows if group is None else group[rows])

    held = [trees(p) for p in parts]
    pairs = [(held[0], held[0])] if len(held) == 1 else [(held[0], held[1])]
    for left, right in pairs:
        for w, (p, flat) in left.items():
            own = tree(p, flat)
            for v, (q, other) in right.items():
                if left is right and v < w:
                    continue
                if left is right and v == w:
                    found, q = traverse(own, own, percent, True), p
                else:
                    mine = flat
                    while mine.shape[1] > other.shape[1]:
                        mine = fold(mine)
                    while other.shape[1] > mine.shape[1]:
                        other = fold(other)
                    found = traverse(own if mine is flat else tree(p, mine), tree(q, other), percent, False)
                for i, j in found:
                    if len(i):
                        yield p[i], q[j]


def block_links(size: np.ndarray, bits: list[bytes], sets: list[np.ndarray], percent: int, group: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Members that links join to other groups (each a group of its own if there are none), and one member of what they
    are joined to. Every link is verified on the sets; members of one group count as joined."""
    parent = list(range(len(size)))
    if group is not None:
        _, first, back = np.unique(group, return_index=True, return_inverse=True)
        parent = first[back].tolist()
    met = set()
    for i, j in candidates(size, bits, percent, group, side):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(parent, a), find(parent, b)
            if p != q and linked(sets[a], sets[b], percent):
                parent[q] = p
                met |= {a, b, p, q}
    return [(a, find(parent, a)) for a in sorted(met) if find(parent, a) != a]


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, size: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys, from sorted batches; a run that exceeds `rows` rows or `size` bytes is cut."""
    held, key, n, held_bytes = [], None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        each = batch.nbytes / batch.num_rows
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            this = tuple(int(c[a]) for c in columns)
            while a < b:
                if held and (this != key or n >= rows or held_bytes >= size):
                    yield key, pa.Table.from_batches(held)
                    held, n, held_bytes = [], 0, 0
                take = min(b - a, rows - n if n < rows else rows, max(1, int((size - held_bytes) / max(each, 1))))
                held.append(batch.slice(a, take))
                key, n, held_bytes, a = this, n + take, held_bytes + take * each, a + take
    if held:
        yield key, pa.Table.from_batches(held)


def together(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, size: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of sorted rows (cut like those of grouped()), many small ones at once: a table and where groups start (n + 1)."""
    held, starts, n = [], [0], 0
    for _, group in grouped(batches, keys, rows, size):
        if held and n + group.num_rows > 16_384:
            yield pa.concat_tables(held), np.array(starts)
            held, starts, n = [], [0], 0
        held.append(group)
        n += group.num_rows
        starts.append(n)
    if held:
        yield pa.concat_tables(held), np.array(starts)


def pairs_of_small(size: np.ndarray, bits: list[bytes], starts: np.ndarray, percent: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may link within groups of at most FAN members: each is one node, so its members are compared at once."""
    count = np.diff(starts)
    which = np.repeat(np.where(count <= FAN, np.arange(len(count)), -1), count)
    found = [np.flatnonzero((which[d:] == which[:-d]) & (which[d:] >= 0)) for d in range(1, FAN)]
    i = np.concatenate(found)
    j = np.concatenate([f + d for d, f in enumerate(found, 1)])
    low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    ok = 100 * low >= percent * high
    if group is not None:
        ok &= group[i] != group[j]
    i, j = i[ok], j[ok]
    if not len(i):
        return i, j
    width = np.fromiter(map(len, bits), np.int64, len(bits))
    stays = np.zeros(len(i), bool)
    flat, place = {}, np.zeros(len(bits), np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        place[at] = np.arange(len(at))
        flat[w] = np.frombuffer(b"".join([bits[k] for k in at.tolist()]), np.uint64).reshape(len(at), w // 8)
    for a, b in {*zip(width[i].tolist(), width[j].tolist(), strict=True)}:
        at = np.flatnonzero((width[i] == a) & (width[j] == b))
        x, y = flat[a][place[i[at]]], flat[b][place[j[at]]]
        while x.shape[1] > y.shape[1]:
            x = fold(x)
        while y.shape[1] > x.shape[1]:
            y = fold(y)
        n, m = size[i[at]], size[j[at]]
        slack = np.minimum(n - np.bitwise_count(x).sum(axis=1, dtype=np.int64), m - np.bitwise_count(y).sum(axis=1, dtype=np.int64))
        most = np.minimum(np.minimum(n, m), np.bitwise_count(x & y).sum(axis=1, dtype=np.int64) + slack)
        stays[at] = most >= -(-percent * (n + m) // (100 + percent))
    return i[stays], j[stays]


def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    values, at = column.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(column.value_lengths().to_numpy())]
    return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def classes_of(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """doc_id, row_key, class, n, the prefix and the signature of each row."""
    level = docs.sparkSession.sparkContext.broadcast(sketch(docs, text_col, k))

    def run(batches):
        for batch in slices(batches, text_col):
            sets = shingle_sets(texts_of(batch, text_col), k)
            n = [len(s) for s in sets]
            kinds = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64)
            keys = [as_long(prefix(s, level.value, percent)) for s in sets]
            at = np.r_[0, np.cumsum([len(x) for x in keys])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(as_long(kinds)), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys))), pa.array([signature(s) for s in sets], pa.binary())], names=["doc_id", "row_key", "class", "n", "keys", "bits"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col), row_key(text_col).alias("row_key"))
    return rows.mapInArrow(released(run), "doc_id long, row_key long, class long, n long, keys array<long>, bits binary")


def shared_only(batches):
    """Of rows sorted by key, those whose key another row has, and those at the ends, whose neighbours are elsewhere."""
    tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table_ = pa.Table.from_batches([tail, batch] if tail is not None else [batch]).combine_chunks()
        first = tail is None
        key = table_["key"].to_numpy()
        same = key[1:] == key[:-1]
        # The last row waits for the next batch; the row before a waiting one is carried so that it is seen from both sides.
        stays = np.r_[True if first else pending, same] | np.r_[same, False]
        pending = bool(stays[-1]) if len(key) > 1 else (True if first else pending)
        out = table_.slice(0, len(key) - 1).filter(pa.array(stays[:-1]))
        tail = table_.slice(len(key) - 1).to_batches()[0]
        yield from out.to_batches()
    if tail is not None:
        yield tail


def fetched(docs: DataFrame, classes: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """class and tokens of the classes in `wanted` (stored), each read from one of its texts again."""

    def run(batches):
        for batch in slices(batches, text_col):
            sets = [s for s in shingle_sets(texts_of(batch, text_col), k) if len(s)]
            if sets:
                at = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
                kinds = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(kinds)), pa.ListArray.from_arrays(pa.array(at), pa.array(as_long(np.concatenate(sets))))], names=["class", "tokens"])

    few = small(wanted)
    wanted = F.broadcast(wanted) if few else wanted
    i, r = fresh(docs, "_set_id"), fresh(docs, "_set_key")
    chosen = classes.join(wanted, "class", "left_semi").groupBy("class").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias(i), F.col("row_key").alias(r))).alias("x")).select("x.*").distinct()
    rows = docs.select(F.col(text_col), F.coalesce(F.col(id_col), F.lit(0)).alias(i), row_key(text_col).alias(r))
    sets = rows.join(F.broadcast(chosen) if few else chosen, [i, r], "left_semi").select(text_col).mapInArrow(released(run), "class long, tokens array<long>")
    return keep(sets.groupBy("class").agg(F.any_value("tokens").alias("tokens")), "sets")


#: Rows of a group: its key and blocks, the block that the class is in, and the component that it is in.
GROUP = ["key", "x", "y"]


def sized(batches: Iterator[pa.RecordBatch], rows: int, size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of each group, sorted by n, the classes with one of another component in reach: sizes without a gap lie between."""
    for held, starts in together(batches, GROUP, rows, size):
        n, root = held["n"].to_numpy(), held["root"].to_numpy()
        new = np.r_[True, 100 * n[:-1] < percent * n[1:]]
        new[starts[:-1]] = True
        first = np.flatnonzero(new)
        mixed = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
        yield from held.filter(pa.array(mixed[np.cumsum(new) - 1])).combine_chunks().to_batches()


def meeting(batches: Iterator[pa.RecordBatch], rows: int, size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of each group, the classes with a partner in another component that the signatures allow."""
    for held, starts in together(batches, GROUP, rows, size):
        mark = np.zeros(held.num_rows, bool)
        n, root, bits = held["n"].to_numpy(), held["root"].to_numpy(), held["bits"].to_pylist()
        i, j = pairs_of_small(n, bits, starts, percent, root)
        mark[i] = mark[j] = True
        x, y, own = (held[c].to_numpy() for c in ("x", "y", "own"))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a > FAN and (root[a:b] != root[a]).any():
                # Of a pair of blocks the rows of one block alone meet in another group.
                side = None if x[a] == y[a] else (own[a:b] == y[a]).astype(np.int64)
                for i, j in candidates(n[a:b], bits[a:b], percent, root[a:b], side):
                    mark[a + i] = mark[a + j] = True
        yield from held.drop(["bits"]).filter(pa.array(mark)).combine_chunks().to_batches()


def joining(batches: Iterator[pa.RecordBatch], rows: int, size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Verified links (u, v) of each group that connect its components."""
    for _, held in grouped(batches, GROUP, rows, size):
        if held.num_rows > 1:
            kinds, root = held["class"].to_numpy(), held["root"].to_numpy()
            x, y = held["x"][0].as_py(), held["y"][0].as_py()
            side = None if x == y or held.num_rows <= FAN else (held["own"].to_numpy() == y).astype(np.int64)
            sets = lists(held["tokens"])
            found = block_links(held["n"].to_numpy(), [signature(t, WIDE) for t in sets], sets, percent, root, side)
            yield pa.RecordBatch.from_arrays([pa.array([kinds[a] for a, _ in found], pa.int64()), pa.array([kinds[b] for _, b in found], pa.int64())], names=["u", "v"])


def searched(fetch, rows: DataFrame, signs: DataFrame, percent: int, most_rows: int, most_bytes: int) -> DataFrame:
    """Verified links of groups; rows: key, x, y, own, class, root, n. Groups over the limits are cut."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shape = "key long, x int, y int, own int, class long, root long, n long"

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts, *GROUP).sortWithinPartitions(*GROUP, "n", "class")

    rows = dealt(rows.select("key", "x", "y", "own", "class", "root", "n")).mapInArrow(lambda b: sized(b, most_rows, most_bytes, percent), shape)
    met = keep(dealt(rows.join(signs, "class").select("key", "x", "y", "own", "class", "root", "n", "bits")).mapInArrow(released(lambda b: meeting(b, most_rows, most_bytes, percent)), shape), "met")
    sets = fetch(keep(met.select("class").distinct(), "wanted"))
    return keep(dealt(met.join(sets, "class")).mapInArrow(released(lambda b: joining(b, most_rows, most_bytes, percent)), "u long, v long"), "links")


def open_rows(shared: DataFrame, roots: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """key, class, root of each class of a bucket, and key, number of classes and shingles of buckets with several components."""
    held = shared.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")) if roots is not None else shared.withColumn("root", F.col("class"))
    held = keep(held, "held")
    keys = held.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("tokens")).filter("a <> b")
    return held, keys.select("key", "m", "tokens")


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    if roots is not None:
        links = links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
    return components(links)


def links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, k: int, percent: int, near: int = NEAR, block: int = BLOCK) -> DataFrame:
    """(node, root) of the components of classes."""
    real = classes.filter("n > 0")
    rows = real.groupBy("class").agg(F.any_value("keys").alias("keys"), F.any_value("n").alias("n")).select(F.explode("keys").alias("key"), "class", "n")
    shared = keep(rows.repartitionByRange("key", "class").sortWithinPartitions("key", "class").mapInArrow(shared_only, "key long, class long, n long"), "shared")
    signs = real.select("class", "bits").join(shared.select("class").distinct(), "class", "left_semi")
    signs = keep(signs.groupBy("class").agg(F.any_value("bits").alias("bits")), "signs")
    fetch = lambda wanted: fetched(docs, real, wanted, id_col, text_col, k)
    roots = None
    for turn in (0, 1):
        # Blocks of two buckets of each class: of neighbours in size, then of classes that chance brings together.
        held, keys = open_rows(shared, roots)
        if turn and keys.isEmpty():
            return roots
        mine = held.join(keys, "key") if turn else held
        ends = mine.groupBy("class").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.any_value("root").alias("root"), F.any_value("n").alias("n"))
        ends = ends.select("class", "root", "n", F.explode(F.array_distinct(F.array("a", "b"))).alias("key"))
        if turn:
            blocks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("key")) / near)
            block_ = F.pmod(F.xxhash64("class", F.lit(turn)), blocks).cast("int")
        else:
            block_ = F.lit(0)
        ends = ends.withColumn("x", block_).select("key", "x", F.col("x").alias("y"), F.col("x").alias("own"), "class", "root", "n")
        roots = merged(roots, searched(fetch, ends, signs, percent, near, NEAR_BYTES))
    held, keys = open_rows(shared, roots)
    if keys.isEmpty():
        return roots
    rows = held.join(keys, "key")
    # Of buckets of up to ONCE classes: a pair of classes that meets in several of them is looked at in one.
    few = rows.filter(F.col("m") <= ONCE).select("key", *[F.struct("class", "root", "n").alias("u")])
    pairs = few.join(few.withColumnRenamed("u", "v"), "key").filter((F.col("u.class") < F.col("v.class")) & (F.col("u.root") != F.col("v.root")))
    pairs = pairs.filter(100 * F.least("u.n", "v.n") >= percent * F.greatest("u.n", "v.n"))
    met = pairs.groupBy("u", "v").agg(F.min("key").alias("key")).select("key", F.explode(F.array("u", "v")).alias("w")).distinct().select("key", *[F.lit(0).alias(c) for c in ("x", "y", "own")], "w.*")
    # A larger bucket of b blocks is searched as b * (b + 1) / 2 pairs of blocks.
    rows = rows.filter(F.col("m") > ONCE).withColumn("blocks", F.ceil(F.greatest(F.col("m") / block, F.col("tokens") / TOKENS)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "class", "root", "n")
    return merged(roots, searched(fetch, rows.unionByName(met), signs, percent, WHOLE, WHOLE))


def join(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, row_key, n_shingles, component_id (the smallest doc_id that links reach)."""
    classes = keep(classes_of(docs, id_col, text_col, k, percent), "classes")
    roots = links(docs, classes, id_col, text_col, k, percent, near, block)
    rows = classes.filter("n > 0").select("doc_id", "row_key", "class", "n").join(roots.withColumnRenamed("node", "class"), "class", "left")
    rows = keep(rows.select("doc_id", "row_key", "n", F.coalesce("root", "class").alias("root")), "rooted")
    named = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(named, "root").select("doc_id", "row_key", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(classes.filter("n = 0").select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose id is the smallest of their component. Rows that repeat one id and text
    stay or go together; of rows with one id and different texts in a component all stay."""
    found = join(docs, k, percent, id_col, text_col)
    dropped = keep(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "row_key"), "near")
    return without(docs, dropped, id_col, text_col)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
