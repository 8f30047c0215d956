"""Queries over the edges of the tables, with a step that deals rows out before they are made distinct or counted.

Their SQL would do as it stands, but its partial aggregates hold as many groups as a split of a file has, and its shuffles have a
fixed number of tasks. Here a task gets about ROWS rows by the hash of its keys, so tasks grow in number and not in size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.graph import stored
from textloom.plans.catalogue import query
from textloom.plans.sql_suite import SQL, views
from textloom.sources.tables import table

#: Rows of a task, and the least number of links that min_degree_subgraph asks of a node.
ROWS, LEAST = 500_000, 20
#: The edges of the small tables; those of lineitem are dealt out.
FEW = """
  SELECT concat('c', c_custkey) AS src, concat('n', c_nationkey) AS dst, 'LOCATED_IN' AS type FROM customer
  UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), 'LOCATED_IN' FROM supplier
  UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), 'PART_OF' FROM nation"""
#: Ids of the nodes and a bit for each type.
TYPES = """
  SELECT concat('c', c_custkey) AS b, 1 AS kind FROM customer
  UNION ALL SELECT concat('s', s_suppkey), 2 FROM supplier
  UNION ALL SELECT concat('p', p_partkey), 4 FROM part
  UNION ALL SELECT concat('n', n_nationkey), 8 FROM nation
  UNION ALL SELECT concat('r', r_regionkey), 16 FROM region"""


def dealt(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """rows, about ROWS of `total` a task, those with equal keys in one."""
    return rows.repartition(max(1, -(-total // ROWS)), *keys)


def supplies(spark, sf) -> tuple[DataFrame, int]:
    """The distinct (src, dst) of lineitem's suppliers and parts, and the number of rows that they come from."""
    lines = table(spark, sf, "lineitem")
    total = lines.count()
    pairs = dealt(lines.select("l_suppkey", "l_partkey"), total, "l_suppkey", "l_partkey").distinct()
    return pairs.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")), total


@query("min_degree_subgraph", SQL["min_degree_subgraph"][1])
def min_degree_subgraph(spark, sf):
    views(spark, sf)
    pairs, total = supplies(spark, sf)
    edges = stored(spark.sql(FEW).unionByName(pairs.withColumn("type", F.lit("SUPPLIES"))))
    # Nodes are few beside edges; those that stay are counted in tasks of ROWS ends.
    ends = edges.select(F.col("src").alias("a")).unionByName(edges.select(F.col("dst").alias("a")))
    keepers = stored(dealt(ends, 2 * total, "a").groupBy("a").count().filter(F.col("count") >= LEAST).select("a"))
    kept = dealt(edges, total, "src").join(dealt(keepers.withColumnRenamed("a", "src"), total, "src"), "src", "left_semi")
    kept = dealt(kept, total, "dst").join(dealt(keepers.withColumnRenamed("a", "dst"), total, "dst"), "dst", "left_semi")
    return kept.select("src", "dst", "type")


@query("bridging", SQL["bridging"][1])
def bridging(spark, sf):
    views(spark, sf)
    pairs, total = supplies(spark, sf)
    edges = spark.sql(FEW).distinct().unionByName(pairs.withColumn("type", F.lit("SUPPLIES")))
    relation = F.when(F.col("type") == "LOCATED_IN", 1).when(F.col("type") == "PART_OF", 2).otherwise(4)
    edges = stored(edges.select("src", "dst", relation.alias("relation")))
    ways = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "relation").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "relation"))
    # Edges are distinct and the ids of both ends tell the relation, so a node has each neighbour once, and types fit into bits.
    met = dealt(ways, 2 * total, "b").join(dealt(spark.sql(TYPES).distinct(), 2 * total, "b"), "b")
    found = dealt(met, 2 * total, "a").groupBy("a").agg(F.count(F.lit(1)).alias("neighbours"), F.bit_count(F.bit_or("kind")).cast("long").alias("types"), F.bit_count(F.bit_or("relation")).cast("long").alias("relations"))
    return found.orderBy(F.desc("types"), F.desc("neighbours"), "a").limit(10)


@query("cooccurrence", SQL["cooccurrence"][1])
def cooccurrence(spark, sf):
    lines = table(spark, sf, "lineitem")
    total = lines.count()
    met = dealt(lines.select("l_orderkey", "l_suppkey"), total, "l_orderkey").distinct()
    a, b = met.withColumnRenamed("l_suppkey", "a"), met.withColumnRenamed("l_suppkey", "b")
    pairs = a.join(b, "l_orderkey").filter("a < b").select("a", "b")
    # An order has some lines, so pairs are about twice the lines.
    return dealt(pairs, 2 * total, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
