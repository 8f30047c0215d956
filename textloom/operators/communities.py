"""GR9: communities of a weighted graph after Louvain, by rounds of joins.

A level starts with each node alone. In a round every node looks at the communities of its neighbours and wishes to join
the one with the largest gain in modularity (ties: the least name). Half of the nodes, drawn anew each round by a hash,
may move at once; of two single nodes that wish to join each other only the one with the larger name may. A round that
doesn't raise the modularity is taken back, and after FAILS of them only unhindered nodes move: those with the
largest gain of all that wish to leave or enter either of their two communities. Their gains add up exactly, so the
modularity rises until no node wishes to move, or by less than LEAST a round. The communities of a level are the nodes of
the next one; levels end when the modularity does not rise.

Everything is fixed by the edges: reruns agree. Each round stores one row a node; the driver learns two numbers of it.
Joins merge: tables of nodes are not broadcast, which would send each of them through the driver in every round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.graph import stored

#: Rounds of half the nodes that may fail, and the least gain in modularity that counts.
FAILS, LEAST = 2, 1e-7


def symmetric(edges: DataFrame) -> DataFrame:
    """(u, v, w) both ways, parallel edges added up; a loop counts twice, as each of its ends does."""
    rows = edges.select("src", "dst", F.col("weight").cast("double").alias("w")).filter("w > 0 AND src IS NOT NULL AND dst IS NOT NULL")
    both = rows.select(F.col("src").alias("u"), F.col("dst").alias("v"), "w").unionByName(rows.select(F.col("dst").alias("u"), F.col("src").alias("v"), "w"))
    return both.groupBy("u", "v").agg(F.sum("w").alias("w"))


def wishes(links: DataFrame, degrees: DataFrame, of: DataFrame, total: float) -> DataFrame:
    """For each node u of community a: its degree k, its weight to its own community (within), the community c that it wishes to
    join, null if none, its gain, and whether both are single nodes of which the other is to move (waits)."""
    members = of.join(degrees.hint("merge"), "u").groupBy("a").agg(F.sum("k").alias("sum"), F.count(F.lit(1)).alias("size"))
    near = links.filter("u <> v").join(of.select(F.col("u").alias("v"), F.col("a").alias("c")).hint("merge"), "v").groupBy("u", "c").agg(F.sum("w").alias("to"))
    # The own community is always looked at, with or without neighbours in it.
    own = of.select("u", F.col("a").alias("c"), F.lit(0.0).alias("to"))
    near = near.unionByName(own).groupBy("u", "c").agg(F.sum("to").alias("to"))
    rows = near.join(of.join(degrees.hint("merge"), "u").hint("merge"), "u").join(members.withColumnRenamed("a", "c").hint("merge"), "c")
    here = F.col("c") == F.col("a")
    gain = F.round(F.col("to") - F.col("k") * (F.col("sum") - F.when(here, F.col("k")).otherwise(0.0)) / total, 9)
    rows = rows.withColumn("gain", gain)
    stay = F.max(F.when(here, F.struct("gain", "to", "size")))
    best = F.min(F.struct((-F.col("gain")).alias("g"), F.col("c"), F.col("size")))
    out = rows.groupBy("u", "a", "k").agg(stay.alias("s"), best.alias("b"))
    more = -F.col("b.g") - F.col("s.gain")
    waits = (F.col("s.size") == 1) & (F.col("b.size") == 1) & (F.col("b.c") > F.col("a"))
    return out.select("u", "a", "k", F.col("s.to").alias("within"), F.when(more > 1e-8, F.col("b.c")).alias("c"), more.alias("gain"), waits.alias("waits"))


def unhindered(found: DataFrame) -> DataFrame:
    """u of the nodes that gain most of all that wish to leave or enter their old or their new community."""
    rows = found.filter("c IS NOT NULL").select(F.explode(F.array("a", "c")).alias("x"), F.struct((-F.col("gain")).alias("g"), F.col("u").alias("u")).alias("s"))
    first = rows.groupBy("x").agg(F.min("s").alias("s")).select("s.u")
    return first.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("u")


def modularity(found: DataFrame, loops: DataFrame, total: float) -> tuple[float, int]:
    """The modularity of the communities of wishes(), and how many nodes wish to move."""
    rows = found.join(loops.hint("merge"), "u", "left")
    by = rows.groupBy("a").agg(F.sum(F.col("within") + F.coalesce("loop", F.lit(0.0))).alias("inside"), F.sum("k").alias("k"), F.count("c").alias("n"))
    r = by.agg(F.sum(F.col("inside") / total - (F.col("k") / total) * (F.col("k") / total)).alias("q"), F.sum("n").alias("n")).first()
    return r["q"], r["n"]


def level(links: DataFrame, total: float) -> tuple[DataFrame, float]:
    """(u, a): the communities that moves of single nodes reach, and their modularity."""
    degrees = stored(links.groupBy("u").agg(F.sum("w").alias("k")))
    loops = links.filter("u = v").select("u", F.col("w").alias("loop"))
    of, best, found, fails, turn = degrees.select("u", F.col("u").alias("a")), None, None, 0, 0
    while True:
        now = stored(wishes(links, degrees, of, total))
        q, n = modularity(now, loops, total)
        if best is None or q > best + LEAST:
            best, found, wish = q, now, n
        elif fails >= FAILS:
            return found.select("u", "a"), best
        else:
            fails += 1
        if not wish:
            return found.select("u", "a"), best
        turn += 1
        if fails < FAILS:
            drawn: Column = F.pmod(F.xxhash64(F.col("u").cast("string"), F.lit(turn)), F.lit(2)) == 0
            of = found.select("u", F.when(drawn & ~F.col("waits"), F.coalesce("c", "a")).otherwise(F.col("a")).alias("a"))
        else:
            of = found.join(unhindered(found).withColumn("moves", F.lit(True)).hint("merge"), "u", "left").select("u", F.when(F.col("moves"), F.col("c")).otherwise(F.col("a")).alias("a"))


def louvain(edges: DataFrame) -> DataFrame:
    """(id, community) of the nodes of edges (src, dst, weight > 0), undirected; a community is named by its least id."""
    links = stored(symmetric(edges))
    total = links.agg(F.sum("w")).first()[0]
    if not total:
        return links.select(F.col("u").alias("id"), F.col("v").alias("community"))
    of, last = None, None
    while True:
        found, q = level(links, total)
        if last is not None and q <= last + LEAST:
            break
        last = q
        of = stored(found.select(F.col("u").alias("id"), "a") if of is None else of.join(found.withColumnRenamed("u", "_u").withColumnRenamed("a", "_a").hint("merge"), F.col("a") == F.col("_u")).select("id", F.col("_a").alias("a")))
        left, right = found.select("u", F.col("a").alias("cu")), found.select(F.col("u").alias("v"), F.col("a").alias("cv"))
        links = stored(links.join(left.hint("merge"), "u").join(right.hint("merge"), "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
    least = of.groupBy("a").agg(F.min("id").alias("community"))
    return of.join(least.hint("merge"), "a").select("id", "community")


def partition_quality(edges: DataFrame, found: DataFrame) -> float:
    """The modularity of communities (id, community) of the graph."""
    links = symmetric(edges)
    total = links.agg(F.sum("w")).first()[0]
    rows = links.join(found.select(F.col("id").alias("u"), F.col("community").alias("a")), "u").join(found.select(F.col("id").alias("v"), F.col("community").alias("b")), "v")
    inside = rows.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("i"), F.sum("w").alias("k"))
    return inside.agg(F.sum(F.col("i") / total - (F.col("k") / total) * (F.col("k") / total))).first()[0]
