"""Iterative graph operators on edge tables: breadth-first search, paths, components, cycles, hierarchies.

Each round is stored in the shared checkpoint folder, so that lineage stays short and lost executors can be replaced.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; in local mode a new folder will do."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, written into the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "type").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))


def bfs(edges: DataFrame, start: str, depth: int, cap: int | None = None, directed: bool = False) -> DataFrame:
    """GR5, GR6, GR7: (id, level) of nodes within `depth`; with a cap, at most so many new neighbours per node and relation."""
    links = edges.select("src", "dst", "type") if directed else both_ways(edges)
    seen = stored(edges.sparkSession.createDataFrame([(start, 0)], "id string, level int"))
    for level in range(1, depth + 1):
        new = links.join(seen.filter(F.col("level") == level - 1).select(F.col("id").alias("src")), "src").join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        if cap:
            new = new.withColumn("k", F.row_number().over(Window.partitionBy("src", "type").orderBy("dst"))).filter(F.col("k") <= cap)
        seen = stored(seen.unionByName(new.select(F.col("dst").alias("id"), F.lit(level).alias("level")).distinct()))
    return seen


def neighborhood(edges: DataFrame, start: str, radius: int) -> DataFrame:
    """GR5, GR7: the edges between nodes within `radius` of the start, whatever their direction."""
    near = stored(bfs(edges, start, radius).select("id"))
    return edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type")


def shortest_path(edges: DataFrame, a: str, b: str, most: int = 6) -> DataFrame:
    """GR4: (hops, nodes, relations) of one shortest undirected path; the first in order of nodes; no row if there is none."""
    # Links are stored once for all rounds; of parallel ones the least path stays.
    links = stored(both_ways(edges))
    front = stored(edges.sparkSession.createDataFrame([(a, [a], [])], "id string, nodes array<string>, relations array<string>"))
    seen = front.select("id")
    for hops in range(most + 1):
        hit = front.filter(F.col("id") == b)
        if not hit.isEmpty() or hops == most:
            return hit.select(F.lit(hops).alias("hops"), "nodes", "relations").orderBy("nodes", "relations").limit(1)
        # The last round needs the links to b only.
        near = links.filter(F.col("dst") == b) if hops == most - 1 else links
        step = front.join(near.withColumnRenamed("src", "id"), "id").select(F.col("dst").alias("id"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("relations", F.col("type")).alias("relations"))
        step = step.join(seen, "id", "left_anti")
        front = stored(step.groupBy("id").agg(F.min(F.struct("nodes", "relations")).alias("p")).select("id", "p.nodes", "p.relations"))
        seen = stored(seen.unionByName(front.select("id")))
    return hit


def connected_components(edges: DataFrame) -> DataFrame:
    """GR9: (id, component), the least id that undirected links reach, by label propagation with pointer jumping."""
    links = both_ways(edges).select("src", "dst").distinct()
    label = stored(links.select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = links.join(label.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("component").alias("m"))
        new = label.join(near.withColumnRenamed("src", "id"), "id", "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = stored(new.join(jump, "component", "left").select("id", F.least("component", F.coalesce("up", "component")).alias("component")))
        changed = not new.exceptAll(label).isEmpty()
        label = new
        if not changed:
            return label


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """GR10: nodes left when nodes without incoming or outgoing edges are peeled off until nothing changes."""
    left = stored(edges.select("src", "dst").distinct())
    n = left.count()
    while True:
        kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        left = stored(kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        now = left.count()
        if now == n:
            break
        n = now
    return left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).distinct()


def hierarchy_paths(parents: DataFrame) -> DataFrame:
    """GR12: (id, depth, path) of rows (id, parent_id) from the roots down, at any depth: each round doubles the piece of the path
    that a row knows. Rows that no root leads to, below a parent that is not there or on a circle, have none."""
    known = stored(parents.select("id", F.col("parent_id").alias("up"), F.lit(0).alias("depth"), F.col("id").cast("string").alias("path")))
    n = known.count()
    for _ in range(n.bit_length() + 1):
        if known.filter("up IS NOT NULL").isEmpty():
            break
        above = known.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"), F.col("path").alias("before"))
        climbed = known.filter("up IS NOT NULL").join(above, "up").select("id", F.col("further").alias("up"), (F.col("depth") + F.col("more") + 1).alias("depth"), F.concat("before", F.lit("/"), "path").alias("path"))
        # A row deeper than there are rows is on a circle.
        known = stored(known.filter("up IS NULL").unionByName(climbed.filter(F.col("depth") < n)))
    return known.filter("up IS NULL").select("id", "depth", "path")


def adopted(clusters: DataFrame, group_rows: int = 100_000) -> DataFrame:
    """GR12: clusters (id, parent_id, x, y) in which top ones without children get the nearest top one that has some as their
    parent (ties: the least id). Without such groups nothing changes."""
    inner = clusters.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
    tops = clusters.filter("parent_id IS NULL")
    groups = stored(tops.join(inner, "id", "left_semi").select(F.col("id").alias("g"), F.col("x").alias("gx"), F.col("y").alias("gy")))
    if groups.count() > group_rows:
        raise ValueError(f"more than {group_rows} groups: cluster them first")
    lone = tops.join(inner, "id", "left_anti").select("id", "x", "y")
    distance = (F.col("x") - F.col("gx")) * (F.col("x") - F.col("gx")) + (F.col("y") - F.col("gy")) * (F.col("y") - F.col("gy"))
    nearest = lone.crossJoin(F.broadcast(groups)).groupBy("id").agg(F.min(F.struct(distance.alias("d"), F.col("g"))).alias("m")).select("id", F.col("m.g").alias("new"))
    return clusters.join(nearest, "id", "left").withColumn("parent_id", F.coalesce("parent_id", "new")).drop("new")
