"""Minimax contiguous partition of documents into shards.

Rows with equal texts form an atomic group; groups stand in the order of their SHA-256, an arbitrary but fixed order
that mixes sources. The smallest capacity with which the ordered groups fit into the shards is found by binary search,
each capacity being checked greedily. Many cuts keep that capacity: between those of the greedy pass, which fills the first
shards, and those of a greedy pass from the end. Each cut is made as near its even share of all bytes as these allow, so
no shard is left with all the slack.

A group larger than a fair share of what is left gets a shard of its own, after the contiguous ones: within one minimax
sequence it would set the capacity and leave later shards empty. There are fewer such groups than shards.

Scale: group sizes and their prefix sums stay in a table of blocks of at most BLOCK groups in the shared folder. The
driver holds one total per block and, of the blocks in which a greedy pass may cut, the prefix sums (least recently
used ones go first). Nothing that grows with the rows is sent to one task.

Defined results: a null text counts no bytes and groups with the empty text; fewer groups than shards leave the last
contiguous shards empty; an empty table gives an empty result. Rows of one group are ordered by id (null first).
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import keep, table

SHARDS = 40
#: Bytes that each row counts besides its text.
ROW_BYTES = 16
#: Groups in a block of prefix sums, groups that the driver reads at once, and groups that it holds (8 bytes each).
BLOCK, READ, HELD = 65_536, 262_144, 8 << 20


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + row_bytes).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("grp"),
    )


def prefixed(batches):
    """Of groups in order: the place and the running size within their partition, by block."""
    place, total, part = 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() if part is None else part
        size = batch.column("size").to_numpy()
        at = place + np.arange(len(size), dtype=np.int64)
        run = total + np.cumsum(size, dtype=np.int64)
        place, total = place + len(size), int(run[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), part, np.int64) << 32 | at // BLOCK), pa.array(at), pa.array(run), pa.array(size), batch.column("grp")], names=["block", "at", "run", "size", "grp"])


class Groups:
    """Prefix sums of ordered groups, read block by block."""

    def __init__(self, stored: DataFrame):
        self.stored = stored
        rows = stored.groupBy("block").agg(F.max("run").alias("run"), F.max("at").alias("at"), F.sum("size").alias("size"), F.max("size").alias("top"), F.count(F.lit(1)).alias("n")).orderBy("block").collect()
        self.ids = [r["block"] for r in rows]
        self.ends = np.cumsum([r["size"] for r in rows], dtype=np.int64)
        self.counts = [r["n"] for r in rows]
        self.place = {b: k for k, b in enumerate(self.ids)}
        self.total = int(self.ends[-1]) if rows else 0
        self.top = max((r["top"] for r in rows), default=0)
        self.held: OrderedDict[int, np.ndarray] = OrderedDict()

    def block(self, k: int) -> np.ndarray:
        """The running sizes of block k, from the start of all groups."""
        if k not in self.held:
            last, n = k, 0
            while last < len(self.ids) and n < READ:
                n += self.counts[last]
                last += 1
            wanted = F.col("block").between(self.ids[k], self.ids[last - 1])
            found = self.stored.filter(wanted).select("block", "at", "size").toPandas().sort_values(["block", "at"])
            for b, rows in found.groupby("block"):
                j = self.place[b]
                self.held[j] = (self.ends[j] - rows["size"].sum()) + np.cumsum(rows["size"].to_numpy(np.int64))
                self.held.move_to_end(j)
            while sum(map(len, self.held.values())) > HELD and len(self.held) > 1:
                self.held.pop(next(j for j in self.held if j != k))
        self.held.move_to_end(k)
        return self.held[k]

    def furthest(self, most: int) -> tuple[int, int, int]:
        """The largest prefix sum that is at most `most`, and where it ends: (sum, block, index in it)."""
        k = int(np.searchsorted(self.ends, most, side="right"))
        if k == len(self.ids):
            return self.total, len(self.ids), -1
        run = self.block(k)
        j = int(np.searchsorted(run, most, side="right")) - 1
        return (int(run[j]), k, j) if j >= 0 else (int(self.ends[k - 1]) if k else 0, k, -1)

    def cuts(self, capacity: int, shards: int) -> list[tuple[int, int]] | None:
        """Where a greedy pass ends its shards (the first group after each), or None if it needs more shards."""
        out, start = [], 0
        for _ in range(shards):
            start, k, j = self.furthest(start + capacity)
            if start >= self.total:
                return out
            out.append((k, j + 1))
        return None

    def minimax(self, shards: int) -> tuple[int, list[tuple[int, int]]]:
        low, high = max(self.top, -(-self.total // shards)), -(-self.total // shards) + self.top
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.cuts(mid, shards) is not None else (mid + 1, high)
        return low, self.cuts(low, shards) or []

    def first_from(self, least: int) -> tuple[int, int, int]:
        """The smallest prefix sum that is at least `least`, and where it ends: (sum, block, index in it)."""
        k = int(np.searchsorted(self.ends, least, side="left"))
        if k == len(self.ids):
            return self.total, len(self.ids), -1
        run = self.block(k)
        j = int(np.searchsorted(run, least, side="left"))
        return int(run[j]), k, j

    def level(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Cuts (the first group after each) that keep the capacity and lie as near even shares as they can."""
        lows = [self.total]
        for _ in range(shards - 1):
            lows.append(self.first_from(max(0, lows[-1] - capacity))[0] if lows[-1] > capacity else 0)
        lows.reverse()
        out, start = [], 0
        for i in range(1, shards):
            ideal = self.total * i / shards
            under, over = self.furthest(int(ideal)), self.first_from(int(ideal) + 1)
            near = under if ideal - under[0] <= over[0] - ideal else over
            # lows[i - 1] is the least sum at which the rest still fits into the shards that are left.
            most, least = self.furthest(start + capacity), max(start, lows[i - 1])
            found = near if least <= near[0] <= most[0] else most if near[0] > most[0] else self.first_from(least)
            if found[0] >= self.total:
                break
            start = found[0]
            out.append((found[1], found[2] + 1))
        return out

    def groups_at(self, places: list[tuple[int, int]]) -> list[bytes]:
        """The groups at places (block, index in it), in their order, read by one job."""
        wanted = [(self.ids[k], (self.ids[k] & 0xFFFFFFFF) * BLOCK + j) for k, j in places]
        if not wanted:
            return []
        rows = self.stored.filter(" OR ".join(f"(block = {b} AND at = {at})" for b, at in dict.fromkeys(wanted))).select("block", "at", "grp").collect()
        found = {(r["block"], r["at"]): bytes(r["grp"]) for r in rows}
        return [found[x] for x in wanted]


def large_groups(sizes: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """The groups that exceed a fair share of what is left without them; fewer than `shards`."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    top = [(bytes(r["grp"]), r["size"]) for r in sizes.orderBy(F.desc("size"), "grp").limit(shards - 1).collect()] if shards > 1 else []
    out = []
    for grp, size in top:
        if size * (shards - len(out)) <= total:
            break
        out.append((grp, size))
        total -= size
    return out


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard and its place (slot, gapless from 0) in the shard."""
    rows = sized(docs, id_col, text_col, row_bytes)
    sizes = keep(rows.groupBy("grp").agg(F.sum("size").alias("size")), "sizes")
    alone = large_groups(sizes, shards)
    rest = shards - len(alone)
    small = sizes.filter(~F.col("grp").isin([g for g, _ in alone])) if alone else sizes
    ordered = small.repartitionByRange("grp").sortWithinPartitions("grp").mapInArrow(prefixed, "block long, at long, run long, size long, grp binary")
    stored = Groups(keep(ordered, "prefix"))
    cuts = stored.level(stored.minimax(rest)[0], rest) if stored.ids else []
    firsts = stored.groups_at([(k, j) if j < len(stored.block(k)) else (k + 1, 0) for k, j in cuts])

    shard: Column = F.lit(0)
    for first in firsts:
        shard = shard + (F.col("grp") >= F.lit(first)).cast("int")
    for n, (grp, _) in enumerate(alone):
        shard = F.when(F.col("grp") == F.lit(grp), F.lit(rest + n)).otherwise(shard)
    order = ["shard", "grp", "doc_id"]
    # Ranges end within groups too (doc_id, crc of the row number break ties), so a group of any size spreads.
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    placed = placed.repartitionByRange(*order, "spread").sortWithinPartitions(*order, "spread").withColumn("row", F.monotonically_increasing_id())
    placed = keep(placed.drop("spread", "grp"), "placed")
    # One row per part and shard: at most the number of parts plus the number of shards.
    parts = placed.groupBy(F.shiftright("row", 33).alias("part"), "shard").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).orderBy("shard", "part").collect()
    base, seen = [], {}
    for r in parts:
        base.append((r["part"], r["shard"], seen.get(r["shard"], 0) - r["first"]))
        seen[r["shard"]] = seen.get(r["shard"], 0) + r["n"]
    spark = docs.sparkSession
    base = spark.createDataFrame(base, "part long, shard int, base long")
    return placed.withColumn("part", F.shiftright("row", 33)).join(F.broadcast(base), ["part", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("row") + F.col("base")).alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
