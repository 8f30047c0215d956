"""Spelling variant grouping: words one edit apart, found by merging errata tries, and the common form of each rare one.

Words are counted over all texts first. Two words are near if they differ by exactly one inserted, deleted or replaced code
point. Such words agree in the first or in the last half of the shorter one, so words meet in groups of a length, a side
and a half; a pair that agrees in both counts in the group of the first half only. A group of more than LIMIT words is dealt
anew by the halves of what is left of its words, and so on.

Within a group the words (without the half that they share) form a trie. At each node the heavy child (with most words)
stays; the words of the light ones are merged into it with an erratum at the node: the first letter replaced by the heavy
child's, the first letter skipped, the heavy child's letter skipped, or the first letter replaced among the light
children, whose words are sorted together without it. Terminals that coincide are a pair. A word is light at no more
nodes than the logarithm of the group, and each pair is found at one node: where its words part.

A word's form is its near word of most occurrences (ties: first in code-point order), if it has `ratio` times the word's;
roots follow forms to the last by pointer jumping. Forms grow by `ratio`, so chains have a logarithm of the counts.

Scale: texts are read once; counts of a task (at most HELD letters) are combined before the shuffle. A task holds one group.

Defined results: null and empty texts have no words; a null id counts as the empty string where slips are planted; equal
rows count again; words of other letters part runs. No other column is read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from itertools import groupby
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import keep, released, slices, small, table, texts_of

#: Letters that make up words, after lower-casing A-Z.
LETTERS = "a-zÀ-ÿ"
LENGTH, COUNT, RATIO = 6, 5, 5
#: Letters of counted words that a task holds, and words and letters of a group that a task searches.
HELD, LIMIT, LIMIT_LETTERS = 4 << 20, 20_000, 8 << 20


def slipped(word: str, doc: int, slip: int) -> str:
    """The word as a document writes it: without one letter, if `slip` divides the hash of both."""
    h = crc32(word.encode(), doc)
    if h % slip:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def vocabulary(docs: DataFrame, length: int = LENGTH, count: int = COUNT, slip: int | None = None, id_col: str = "doc_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """word, n: words of at least `length` letters and `count` occurrences. slip: plants deletions, see slipped()."""
    runs = re.compile(f"[{LETTERS}]{{{length},}}")

    def run(batches):
        total: Counter[str] = Counter()
        letters = 0

        def given():
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in slices(batches, "text"):
            for i, text in zip(batch.column("doc_id").to_pylist(), pc.ascii_lower(texts_of(batch)).to_pylist(), strict=True):
                doc = crc32(f"{'' if i is None else i}:".encode())
                for word, n in Counter(runs.findall(text)).items():
                    if slip:
                        word = slipped(word, doc, slip)
                        if len(word) < length:
                            continue
                    if word not in total:
                        letters += len(word) + 50
                    total[word] += n
                if letters > held:
                    yield given()
                    total, letters = Counter(), 0
        if total:
            yield given()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def by_halves(rows: DataFrame) -> DataFrame:
    """Two rows for each: its group of the first and of the last half of what is left between `front` and `back`."""
    half = F.floor((F.col("band") - F.col("front") - F.col("back")) / 2).cast("int")
    size = F.char_length("word")
    first = F.struct(
        F.concat("key", F.array(F.concat(F.lit("<"), F.substring("word", F.col("front") + 1, half)))).alias("key"), (F.col("front") + half).alias("front"), F.col("back").alias("back"), F.col("differ").alias("differ"),
    )
    last = F.struct(
        F.concat("key", F.array(F.concat(F.lit(">"), F.substring("word", size - F.col("back") - half + 1, half)))).alias("key"), F.col("front").alias("front"), (F.col("back") + half).alias("back"),
        F.concat("differ", F.array(F.struct(F.col("front").alias("at"), half.alias("size")))).alias("differ"),
    )
    return rows.select("word", "n", "band", F.explode(F.array(first, last)).alias("g")).select("word", "n", "band", "g.*")


def groups(words: DataFrame, length: int, limit: int = LIMIT, limit_letters: int = LIMIT_LETTERS) -> DataFrame:
    """word, n, band (letters of the shorter word of a pair), key of the group, letters that the group shares in front and
    back, and slices (at, size) in which a pair has to differ, as it is found elsewhere else."""
    size = F.char_length("word")
    start = words.select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda b: b >= length)).alias("band"))
    start = start.select("word", "n", "band", F.array(F.col("band").cast("string")).alias("key"), F.lit(0).alias("front"), F.lit(0).alias("back"), F.array().cast("array<struct<at: int, size: int>>").alias("differ"))
    rows, out = by_halves(start), None
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("words"), F.sum(F.char_length("word")).alias("letters"), F.min(F.col("band") - F.col("front") - F.col("back")).alias("left"))
        large = keep(sizes.filter(((F.col("words") > limit) | (F.col("letters") > limit_letters)) & (F.col("words") > 1) & (F.col("left") > 1)).select("key"), "large")
        if large.isEmpty():
            return rows if out is None else out.unionByName(rows)
        if small(large):
            large = F.broadcast(large)
        fit = rows.join(large, "key", "left_anti").select(*rows.columns)
        out = fit if out is None else out.unionByName(fit)
        rows = keep(by_halves(rows.join(large, "key", "left_semi").select(*rows.columns)), "halves")


def children(words: list[str], low: int, high: int, depth: int) -> list[tuple[int, int]]:
    """The children of the trie node of sorted words[low:high], all longer than depth, where they share `depth` letters."""
    out = []
    while low < high:
        c = words[low][depth]
        end = bisect_left(words, words[low][:depth] + chr(ord(c) + 1), low, high) if ord(c) < 0x10FFFF else high
        out.append((low, end))
        low = end
    return out


def near_pairs(words: list[str]):
    """Pairs (i, j) of the sorted distinct words one edit apart, each once."""
    place = {w: i for i, w in enumerate(words)}
    stack = [(0, len(words), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2:
            continue
        first, last = words[low], words[high - 1]
        while depth < len(first) and first[depth] == last[depth]:
            depth += 1
        stem = first[:depth]
        ends = len(first) == depth
        nodes = children(words, low + ends, high, depth)
        heavy = max(nodes, key=lambda x: x[1] - x[0])
        c = words[heavy[0]][depth]
        stack += [(a, b, depth + 1) for a, b in nodes]
        errata = []
        if ends and stem + c in place:
            yield low, place[stem + c]
        for light in nodes:
            if light == heavy:
                continue
            for i in range(*light):
                head, rest = words[i][depth], words[i][depth + 1 :]
                errata.append((rest, i))
                found = [place.get(stem + c + rest), place.get(stem + c + head + rest), None if rest[:1] == head else place.get(stem + rest)]
                yield from ((i, j) for j in found if j is not None)
        errata.sort()
        for _, same in groupby(errata, lambda x: x[0]):
            same = [i for _, i in same]
            yield from ((i, j) for k, i in enumerate(same) for j in same[k + 1 :])


def searched(words: list[str], counts: list[int], band: int, front: int, back: int, differ: list[dict]) -> list[tuple[str, int, int, str]]:
    """word, near words found, and the best of them with its count, for the words of a group that have any."""
    left = sorted((w[front : len(w) - back], w, n) for w, n in zip(words, counts, strict=True))
    near, best = [0] * len(left), [(0, "")] * len(left)
    for i, j in near_pairs([x[0] for x in left]):
        (_, u, _), (_, v, _) = left[i], left[j]
        if min(len(u), len(v)) != band or any(u[d["at"] : d["at"] + d["size"]] == v[d["at"] : d["at"] + d["size"]] for d in differ):
            continue
        for a, b in ((i, j), (j, i)):
            near[a] += 1
            best[a] = min(best[a], (-left[b][2], left[b][1]))
    return [(x[1], k, -n, w) for x, k, (n, w) in zip(left, near, best, strict=True) if k]


def neighbours(words: DataFrame, length: int = LENGTH, limit: int = LIMIT, limit_letters: int = LIMIT_LETTERS) -> DataFrame:
    """word, n_near, best_n, best: of the words (word, n; stored) that have near ones, how many and the most frequent one."""

    def run(batches):
        key, group = None, []

        def given(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])

        def done():
            if len(group) < 2:
                return []
            r = group[0]
            return searched([x["word"] for x in group], [x["n"] for x in group], r["band"], r["front"], r["back"], r["differ"])

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    out += done()
                    key, group = row["key"], []
                group.append(row)
            if out:
                yield given(out)
        if out := done():
            yield given(out)

    dealt = groups(words, length, limit, limit_letters).repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(released(run), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): the last form that the word leads to."""
    jumps = keep(forms.select("word", F.col("form").alias("root")), "jumps")
    while True:
        further = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = keep(jumps.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "jumps")
        jumps = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return jumps


def variants(words: DataFrame, length: int = LENGTH, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """Of words (word, n): word, form, root, n, n_near, form_n."""
    words = keep(words, "vocabulary")
    near = neighbours(words, length, limit)
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    found = keep(found, "forms")
    return found.join(roots(found.filter("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_groups(found: DataFrame) -> DataFrame:
    """root, words: the words that lead to each root, where there are any."""
    return found.filter("root <> word").groupBy("root").agg(F.array_sort(F.collect_list("word")).alias("words"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents"), slip=199))
