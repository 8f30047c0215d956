"""Domains of relation names by their embeddings: near pairs, density clusters, cohesion, merging, terms of topics.

Relation names are a vocabulary: near pairs are exact, by products of blocks.
Rows whose id or vector is null, or whose vector has no length, are near nothing. Ids are unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.graph import connected_components, stored
from textloom.operators.search import ranked
from textloom.operators.vectors import product_pairs, unit, units


def near_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(x, y), x < y, of rows (id, vector) whose cosine is `least` or more: exact, block by block. vectors.hashed_pairs compares
    few pairs, with a stated recall."""
    return product_pairs(units(rows), least)


def density_clusters(rows: DataFrame, least: float = 0.7, fewest: int = 3) -> DataFrame:
    """ON1: (id, cluster, core): rows with `fewest` near ones, themselves included, are cores; linked cores form a cluster,
    named by its least id; others near a core join the cluster with the least name; the rest has no row."""
    pairs = near_pairs(rows, least)
    near = stored(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    cores = stored(near.groupBy("x").agg((F.count(F.lit(1)) + 1).alias("n")).filter(F.col("n") >= fewest).select("x"))
    links = near.join(cores, "x", "left_semi").join(cores.select(F.col("x").alias("y")), "y", "left_semi").select(F.col("x").alias("src"), F.col("y").alias("dst"))
    links = links.unionByName(cores.select(F.col("x").alias("src"), F.col("x").alias("dst"))).withColumn("type", F.lit("near"))
    found = connected_components(links).withColumnRenamed("component", "cluster")
    edge = near.join(found.select(F.col("id").alias("y"), "cluster"), "y").join(cores, "x", "left_anti")
    edge = edge.groupBy(F.col("x").alias("id")).agg(F.min("cluster").alias("cluster"))
    return found.withColumn("core", F.lit(True)).unionByName(edge.withColumn("core", F.lit(False)))


def cohesion(rows: DataFrame) -> DataFrame:
    """ON2: (domain, n, cohesion) of rows (domain, vector): the mean cosine of all pairs, from the length of the sum of the
    unit vectors; null for a single row."""
    parts = rows.select("domain", F.posexplode(unit(F.col("vector"))).alias("k", "v")).groupBy("domain", "k").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    total = parts.groupBy("domain").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"))
    return total.select("domain", "n", F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("cohesion"))


def centroids(rows: DataFrame) -> DataFrame:
    """(id, vector): the mean vector of each domain of rows (domain, vector)."""
    parts = rows.select("domain", F.posexplode("vector").alias("k", "v")).groupBy("domain", "k").agg(F.avg("v").alias("m"))
    # One entry per dimension, so the lists are as long as a vector.
    made = parts.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("l"))
    return made.select(F.col("domain").alias("id"), F.transform("l", lambda x: x["m"]).alias("vector"))


def mergers(domains: DataFrame, least: float = 0.85) -> DataFrame:
    """ON4: (id, keep): the least id of the domains (id, vector) that near pairs link, itself if there is none."""
    alone = domains.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    links = near_pairs(domains, least).toDF("src", "dst").unionByName(alone).withColumn("type", F.lit("near"))
    return connected_components(links).withColumnRenamed("component", "keep")


def topic_terms(words: DataFrame, most: int = 10) -> DataFrame:
    """CL3: (topic, word, weight) of rows (topic, word): the largest tf * ln(1 + mean words of a topic / frequency of the
    word) of each topic, weights rounded to six places, ties by word."""
    counts = words.groupBy("topic", "word").agg(F.count(F.lit(1)).alias("n"))
    by_word = counts.groupBy("word").agg(F.sum("n").alias("f"))
    mean = F.broadcast(counts.agg((F.sum("n") / F.count_distinct("topic")).alias("mean")))
    size = F.broadcast(counts.groupBy("topic").agg(F.sum("n").alias("size")))
    weight = F.round(F.col("n") / F.col("size") * F.log1p(F.col("mean") / F.col("f")), 6)
    rows = counts.join(by_word, "word").join(size, "topic").crossJoin(mean).withColumn("weight", weight)
    return ranked(rows, F.desc("weight"), F.asc("word"), partition=["topic"]).filter(F.col("rank") < most).select("topic", "word", "weight")
