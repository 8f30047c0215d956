"""Greedy packing of ordered items into chunks without one call for a whole sequence.

Where a chunk that is opened by an item ends follows from prefix sums alone, so each item's successor, the opener of the
next chunk, is one as-of join. The items that open chunks are those that the first one reaches: they are marked by
pointer jumping, in as many rounds as the logarithm of the chunks. A chunk is then put together from its own items only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.graph import stored
from textloom.operators.ranks import running
from textloom.operators.time_joins import asof


def openers(items: DataFrame, group: str, most: int, overlap: int = 0) -> DataFrame:
    """(group, first, last, opener) of items (group, pos from 0, before, after): the sums of what the items before, and with it,
    take. The chunk of an opener j holds the `overlap` items before it, j itself, and further ones as long as all take at most
    `most`; the first one that doesn't fit opens the next."""
    own = stored(items.select(group, "pos", "before", "after"))
    start = own.select(group, F.col("pos").alias("id"), F.greatest(F.col("pos") - overlap, F.lit(0)).alias("from"))
    at = own.select(group, F.col("pos").alias("from"), F.col("before").alias("base"))
    probes = start.join(at, [group, "from"]).select(group, "id", (F.col("base") + most + 1).alias("t"))
    points = own.select(group, F.col("pos").alias("pid"), F.col("after").alias("t"))
    # One group holds ids that others have too: the pair names an item.
    pair = F.struct(F.col(group).alias("g"), F.col("id").alias("p"))
    found = asof(probes.withColumn("id", pair), points, group, "forward").select(F.col("id.g").alias(group), F.col("id.p").alias("pos"), "pid")
    jump = stored(found.select(group, "pos", F.when(F.col("pid").isNotNull(), F.greatest("pid", F.col("pos") + 1)).alias("next")))
    successor, reached = jump, stored(own.filter("pos = 0").select(group, "pos"))
    while True:
        further = reached.join(jump, [group, "pos"]).filter("next IS NOT NULL").select(group, F.col("next").alias("pos"))
        new = further.join(reached, [group, "pos"], "left_anti")
        if new.isEmpty():
            break
        reached = stored(reached.unionByName(new).distinct())
        twice = jump.select(group, F.col("pos").alias("next"), F.col("next").alias("then"))
        jump = stored(jump.join(twice, [group, "next"]).select(group, "pos", F.col("then").alias("next")))
    length = own.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    out = reached.join(successor, [group, "pos"]).join(length, group)
    return out.select(group, F.greatest(F.col("pos") - overlap, F.lit(0)).alias("first"), (F.coalesce("next", "n") - 1).alias("last"), F.col("pos").alias("opener"))


def packed(rows: DataFrame, group: str, order: list[str], size: Column, most: int, overlap: int = 0, joint: int = 1) -> DataFrame:
    """The rows with their chunk: (columns of rows, chunk_index, chunk_total, pos); a row that two chunks share comes twice. `size`
    is what an item takes, `joint` what stands between two. Rows that tie in the order stand in an arbitrary, fixed order."""
    sized = rows.withColumn("size", size.cast("long") + joint)
    placed = stored(running(sized, group, [F.col(c) for c in order], F.col("size")))
    # An item fits if all sizes and the joints between them are at most `most`.
    items = placed.select(group, "pos", F.col("sum").alias("before"), (F.col("sum") + F.col("size")).alias("after"))
    spans = stored(openers(items, group, most + joint, overlap))
    numbered = running(spans, group, [F.col("opener")], F.lit(1)).withColumnRenamed("pos", "chunk_index").drop("sum")
    total = spans.groupBy(group).agg(F.count(F.lit(1)).alias("chunk_total"))
    # A chunk has no more items than `most` has room for, beside the overlap and its opener, as each takes its joint at least.
    members = numbered.join(total, group).select(group, "chunk_index", "chunk_total", F.explode(F.sequence("first", "last")).alias("pos"))
    return members.join(placed.drop("size", "sum"), [group, "pos"])


def segment_chunks(segments: DataFrame, most: int = 500, overlap: int = 2) -> DataFrame:
    """CH4: ordered segments (episode, start, end, text) packed per episode into about `most` letters, a blank after each segment but
    the last; a chunk repeats the last `overlap` segments. A null text counts as empty."""
    rows = packed(segments.withColumn("text", F.coalesce("text", F.lit(""))), "episode", ["start", "end"], F.length("text"), most, overlap)
    texts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    out = rows.groupBy("episode", "chunk_index", "chunk_total").agg(F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), F.array_join(F.transform(texts, lambda x: x["text"]), " ").alias("chunk"))
    return out.select("episode", "chunk_index", F.col("chunk_total").cast("long").alias("chunk_total"), "start", "end", "chunk")


def page_windows(pages: DataFrame, size: int = 500, overlap: int = 75, least: int = 50) -> DataFrame:
    """CH7: windows of `size` words along a book (doc_id, page, text), each with the pages that it touches; pages under `least`
    words are left out. A page gives each window that it meets its own words; no book is put together."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    rows = pages.select("doc_id", "page", words.alias("w")).filter(F.size("w") >= least).withColumn("n", F.size("w").cast("long"))
    placed = running(rows, "doc_id", [F.col("page")], F.col("n"))
    step = size - overlap
    first = F.greatest(F.lit(0), F.floor((F.col("sum") - size) / step) + 1)
    last = F.floor((F.col("sum") + F.col("n") - 1) / step)
    parts = placed.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    start = F.col("k") * step - F.col("sum")
    inside = F.slice("w", (F.greatest(start, F.lit(0)) + 1).cast("int"), (F.least(start + size, F.col("n")) - F.greatest(start, F.lit(0))).cast("int"))
    parts = parts.select("doc_id", (F.col("k") * step).alias("start"), "page", "pos", F.array_join(inside, " ").alias("t"))
    made = parts.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "page", "t"))).alias("p"))
    return made.select("doc_id", "start", F.array_distinct(F.transform("p", lambda x: x["page"])).alias("pages"), F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("chunk"))
