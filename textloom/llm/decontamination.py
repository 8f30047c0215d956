"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Words are lower-cased runs of letters and digits. A mask is laid on every place of a text: the words at its ones are hashed,
those at its zeros are ignored. Keys of the benchmark and of the documents are joined, and at a hit the item is laid on the
document along its diagonal (document place less benchmark place) and words are compared by position: a leak is a window of
WINDOW words of the item (the whole item if it is shorter) of which SHARE or more stand in the document at their places.

A family of masks is lossless for w words with c changed ones if every pattern of c changes leaves one mask of it whole at
some place within the w words. For each item length the heaviest family that is lossless for its window is taken; families are
checked by enumeration of all patterns when they are chosen. Where no change is allowed (up to four words) the whole item
is the seed; for windows or shares with more patterns than PATTERNS, or without a lossless family, unbroken runs take the
masks' place: (w - c) / (c + 1) unchanged words, rounded up, stand together in each leak.

The keys of the benchmark, three numbers and a mask a row, are broadcast if they are at most SEED_ROWS rows, the items' words
if they take at most ITEM_BYTES, and the hits (ids and diagonals, equal ones combined before they travel) if they are at
most SEED_ROWS rows, each measured first; documents with hits are then read again for the check and no text is shuffled.
Beyond that the joins shuffle; adaptive execution splits keys that many texts share.

Defined results: null and empty texts, and items without words, never match; a document is reported once for each item
that it holds, with its best window; repeated rows count as one; items with the same words are searched once and reported
each; an item that occurs often is found in every document.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import keep, row_key, small, table, without

WINDOW, SHARE = 20, 0.8
#: Families of masks, found by a search over all patterns of changes: for 17 words or more with 4 changed, 8 with 1 or 11 to
#: 24 with up to 4, 10 with 2, and 5 with 1.
FAMILIES = (("11001111", "1110101001", "111001000000011"), ("10111",), ("11101", "1001011"), ("1011", "1101"))
SEED_ROWS, ITEM_BYTES = 500_000, 64 << 20
#: Patterns of changes that may be enumerated to check a family.
PATTERNS = 50_000


@lru_cache(maxsize=None)
def lossless(family: tuple[str, ...], w: int, c: int) -> bool:
    """Whether each way to change c of w words leaves a mask of the family whole at some place."""
    places = [sum(1 << (s + o) for o in ones(m)) for m in family for s in range(w - len(m) + 1)]
    return all(any(not p & changed for p in places) for changed in (sum(1 << k for k in ks) for ks in combinations(range(w), c)))


@lru_cache(maxsize=None)
def masks_of(n: int, window: int = WINDOW, share: float = SHARE) -> tuple[str, ...]:
    """The masks for items of n words."""
    w = min(n, window)
    same = math.ceil(w * share)
    c = w - same
    if c and math.comb(w, c) <= PATTERNS:
        found = [needed(f, w, c) for f in FAMILIES if lossless(f, w, c)]
        if found:
            return max(found, key=lambda f: (min(m.count("1") for m in f), -len(f)))
    return ("1" * max(1, -(-same // (c + 1))),)


def needed(family: tuple[str, ...], w: int, c: int) -> tuple[str, ...]:
    """The family without masks that it can do without."""
    for m in family:
        left = tuple(x for x in family if x != m)
        if lossless(left, w, c):
            return needed(left, w, c)
    return family


def ones(mask: str) -> list[int]:
    return [k for k, x in enumerate(mask) if x == "1"]


def words(text: Column) -> Column:
    """The words of a text; an empty array for null and for texts without words."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seed(h: Column, at: Column, mask: str) -> Column:
    """The key of a mask at a place; null where it doesn't fit."""
    return F.when(at + len(mask) <= F.size(h), F.xxhash64(F.lit(mask), *[F.get(h, at + o) for o in ones(mask)]))


def seeds_of(items: DataFrame, families: dict[str, list[int]], window: int) -> DataFrame:
    """uid, q, mask, key of items (uid, item_h): families has the lengths (up to the window) for which each mask is used."""
    rows = items.select("uid", "item_h", F.posexplode("item_h").alias("q", "_w")).drop("_w")
    keys = [F.when(F.least(F.size("item_h"), F.lit(window)).isin(lengths), F.struct(F.lit(mask).alias("mask"), seed(F.col("item_h"), F.col("q"), mask).alias("key"))) for mask, lengths in families.items()]
    rows = rows.select("uid", "q", F.explode(F.array(*keys) if keys else F.array().cast("array<struct<mask: string, key: bigint>>")).alias("s"))
    return rows.select("uid", "q", "s.mask", "s.key").filter("key IS NOT NULL")


def laid(h: Column, diagonal: Column, n: Column) -> Column:
    """The n words of a document at an item's places, null where the document has none."""
    inside = F.slice(h, F.greatest(diagonal, F.lit(0)) + 1, n)
    return F.when(diagonal >= 0, inside).otherwise(F.concat(F.array_repeat(F.lit(None).cast("long"), -diagonal), inside))


def measured(hits: DataFrame, window: int) -> DataFrame:
    """Of rows with part (the words at the item's places) and item_h: the matches of the best window and of the item."""
    wide = F.least(F.size("item_h"), F.lit(window))
    fits = F.transform("item_h", lambda x, i: F.get("part", i).eqNullSafe(x).cast("int"))
    rows = hits.withColumn("_fits", fits).withColumn("_sums", F.transform(F.sequence(F.lit(1), F.size("item_h") - wide + 1), lambda s: F.aggregate(F.slice("_fits", s, wide), F.lit(0), lambda a, b: a + b)))
    rows = rows.withColumn("window_words", wide).withColumn("window_matches", F.array_max("_sums")).withColumn("item_matches", F.aggregate("_fits", F.lit(0), lambda a, b: a + b))
    return rows.drop("_fits", "_sums", "part")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, share: float = SHARE, seed_rows: int = SEED_ROWS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row per document and item that it holds: doc_id, row_key, item_id, word_start, window and item matches."""
    named = keep(benchmark.select("item_id", hashed(F.col("text")).alias("item_h")).filter(F.size("item_h") > 0).distinct(), "benchmark")
    items = keep(named.select("item_h").distinct().withColumn("uid", F.monotonically_increasing_id()), "items")
    # At most `window` lengths.
    lengths = sorted(r[0] for r in items.select(F.least(F.size("item_h"), F.lit(window)).alias("n")).distinct().collect())
    families: dict[str, list[int]] = {}
    for n in lengths:
        for mask in masks_of(n, window, share):
            families.setdefault(mask, []).append(n)
    seeds = keep(seeds_of(items, families, window), "seeds")
    fits = (items.agg(F.sum(F.size("item_h") * 8 + 64)).first()[0] or 0) <= item_bytes
    words_of_items = F.broadcast(items) if fits else items
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(text_col).alias("row_key"), hashed(F.col(text_col)).alias("h"))
    keyed = rows.select("doc_id", "row_key", "h", F.posexplode_outer("h").alias("p", "_w")).drop("_w")
    keys = [seed(F.col("h"), F.col("p"), mask) for mask in families]
    keyed = keyed.select("doc_id", "row_key", "p", F.explode(F.array(*keys) if keys else F.array().cast("array<bigint>")).alias("key")).filter("key IS NOT NULL")
    # Hits of all masks along one diagonal are one row, before anything else of them travels.
    narrow = keyed.join(F.broadcast(seeds) if small(seeds, seed_rows) else seeds, "key").select("doc_id", "row_key", "uid", (F.col("p") - F.col("q")).alias("diagonal")).distinct()
    narrow = keep(narrow, "hits")
    few = small(narrow, seed_rows)

    def met(x: DataFrame, y: DataFrame, how: str) -> DataFrame:
        y = y.select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k"), *[c for c in y.columns if c not in ("doc_id", "row_key")])
        return x.join(F.broadcast(y) if few else y, F.col("row_key").eqNullSafe(F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), how)

    # Only documents with hits are cut into words again, each once.
    texts = met(docs.select(F.col(id_col).alias("doc_id"), row_key(text_col).alias("row_key"), F.col(text_col).alias("text")), narrow.select("doc_id", "row_key").distinct(), "left_semi")
    hits = met(texts.select("doc_id", "row_key", hashed(F.col("text")).alias("h")), narrow, "inner").join(words_of_items, "uid")
    hits = hits.select("doc_id", "row_key", "uid", "item_h", "diagonal", laid(F.col("h"), F.col("diagonal"), F.size("item_h")).alias("part"))
    best = F.max(F.struct("window_matches", "item_matches", (-F.col("diagonal")).alias("start"), "window_words")).alias("b")
    found = measured(hits, window).groupBy("doc_id", "row_key", "uid").agg(best)
    found = found.filter(F.col("b.window_matches") >= F.ceil(F.col("b.window_words") * F.lit(share)))
    members = named.join(items, "item_h").select("uid", "item_id")
    found = found.join(F.broadcast(members) if fits else members, "uid")
    return found.select("doc_id", "row_key", "item_id", F.greatest(-F.col("b.start"), F.lit(0)).cast("long").alias("word_start"), F.col("b.window_words").cast("long").alias("window_words"), F.col("b.window_matches").cast("long").alias("window_matches"), F.col("b.item_matches").cast("long").alias("item_matches"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item of the benchmark, with all their columns."""
    found = keep(leaks(docs, benchmark, id_col, text_col).select("doc_id", "row_key").distinct(), "leaks")
    return without(docs, found, id_col, text_col)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.max(F.struct("window_matches", "item_matches", (-F.col("word_start")).alias("start"), "window_words")).alias("b")
    found = found.groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", (-F.col("b.start")).alias("word_start"), "b.window_words", "b.window_matches", "b.item_matches")
