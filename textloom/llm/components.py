"""Connected components of a table of links, by alternating stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import keep


def are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one smaller node that hangs on none; edges(u, v) are distinct with v < u."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
    inner = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return twice.unionByName(inner).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs -> (node, root): the smallest node of its component for every node that isn't the smallest.

    Large-star hooks larger neighbours to the least one, small-star hooks smaller ones; each round is stored in the
    shared folder. Rounds grow with the logarithm of the longest path. Hot nodes are pre-aggregated before the shuffle
    and their joins can be split by adaptive execution.
    """
    edges = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = keep(small.distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
