"""CL4: a plane layout of vectors by their neighbour graph, in rounds of joins.

The graph of nearest neighbours is found by neighbour descent: each row starts with neighbours drawn by a hash and takes, round
after round, the nearest of its neighbours' neighbours and of those whose neighbour it is, until few change. No pairs
but these are compared. The layout starts from two principal components. In each round every edge draws its ends together
and every row is pushed away by a few rows drawn anew, with the forces of a neighbour embedding (1 / (1 + A d^2B)); steps
shrink to nothing.

Scale: a round shuffles rows times neighbours, and a descent round that number squared per row; rows that very many have as
neighbour pass on at most NEIGHBOURS of them. All draws are hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.graph import stored
from textloom.operators.ranks import ranked
from textloom.operators.vectors import dot, units

NEIGHBOURS, ROUNDS, DRAWN = 15, 30, 5
#: Form of the forces, for points that may come as near as a tenth of the unit.
A, B = 1.577, 0.895
#: Longest pull or push along an axis in a round, before it is multiplied by the step.
MOST = 4.0


def first(rows: DataFrame, node: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each node."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(node).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")


def measured(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """(x, y, near) of pairs (x, y): the cosine of both."""
    a, b = own.select(F.col("id").alias("x"), F.col("u").alias("ux")), own.select(F.col("id").alias("y"), F.col("u").alias("uy"))
    return pairs.join(a, "x").join(b, "y").select("x", "y", F.round(dot(F.col("ux"), F.col("uy")), 9).alias("near"))


def drawn(numbered: DataFrame, n: int, k: int, seed: int) -> DataFrame:
    """(x, y): for each row (id, rank) k other ones, drawn by a hash."""
    other = F.pmod(F.xxhash64("rank", F.lit(seed), F.col("j")), F.lit(n))
    rows = numbered.select(F.col("id").alias("x"), "rank", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("j")).select("x", other.alias("rank"))
    return rows.join(numbered.select("rank", F.col("id").alias("y")), "rank").filter("x <> y").select("x", "y").distinct()


def neighbours(rows: DataFrame, k: int = NEIGHBOURS, most: int = 12, change: float = 0.01) -> DataFrame:
    """(x, y, near): about the k nearest rows of each row (id, vector), by neighbour descent; fewer only where there are fewer
    rows. At most `most` rounds, fewer when less than the share `change` of the neighbours is new."""
    own = stored(units(rows))
    numbered = stored(ranked(own.select("id"), [F.col("id")]))
    n = numbered.count()
    best = [F.desc("near"), F.asc("y")]
    graph = stored(first(measured(drawn(numbered, n, k, 0), own), "x", k, *best).withColumn("new", F.lit(True)))
    for turn in range(1, most + 1):
        # Of those whose neighbour a row is, it passes on k, drawn anew.
        back = first(graph.select(F.col("y").alias("x"), F.col("x").alias("y"), "new"), "x", k, F.xxhash64("x", "y", F.lit(turn)))
        around = stored(graph.select("x", "y", "new").unionByName(back).groupBy("x", "y").agg(F.max("new").alias("new")))
        left, right = around.select(F.col("x").alias("m"), F.col("y").alias("x"), F.col("new").alias("a")), around.select(F.col("x").alias("m"), "y", F.col("new").alias("b"))
        # Only pairs that a new edge brings together were not compared before.
        met = left.join(right, "m").filter("x <> y AND (a OR b)").select("x", "y").distinct()
        fresh = measured(met.join(graph.select("x", "y"), ["x", "y"], "left_anti"), own).withColumn("new", F.lit(True))
        graph = stored(first(graph.withColumn("new", F.lit(False)).unionByName(fresh), "x", k, *best))
        if graph.filter("new").count() < change * n * k:
            break
    return graph.select("x", "y", "near")


def start(rows: DataFrame) -> DataFrame:
    """(id, p, q): two principal components, spread over ten units."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = units(rows).select("id", array_to_vector("u").alias("v"))
    made = PCA(k=2, inputCol="v", outputCol="c").fit(own).transform(own).select("id", vector_to_array("c").alias("c")).select("id", F.col("c")[0].alias("p"), F.col("c")[1].alias("q"))
    spread = F.broadcast(made.agg(F.max(F.abs("p")).alias("a"), F.max(F.abs("q")).alias("b")))
    unit_of = lambda x, w: F.when(F.col(w) > 0, F.col(x) / F.col(w) * 10).otherwise(0.0)
    return stored(made.crossJoin(spread).select("id", unit_of("p", "a").alias("p"), unit_of("q", "b").alias("q")))


def held(force: Column) -> Column:
    return F.greatest(F.lit(-MOST), F.least(F.lit(MOST), force))


def layout(rows: DataFrame, k: int = NEIGHBOURS, rounds: int = ROUNDS, drawn_rows: int = DRAWN, graph: DataFrame | None = None) -> DataFrame:
    """(id, p, q): places of rows (id, vector) in the plane; rows without a direction have none."""
    if units(rows).isEmpty():
        return rows.select("id", F.lit(0.0).alias("p"), F.lit(0.0).alias("q")).filter("false")
    graph = stored(neighbours(rows, k) if graph is None else graph)
    links = stored(graph.select("x", "y").unionByName(graph.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    at = start(rows)
    numbered = stored(ranked(at.select("id"), [F.col("id")]))
    n = numbered.count()
    for turn in range(rounds):
        step = 1.0 - turn / rounds
        other = at.select(F.col("id").alias("y"), F.col("p").alias("py"), F.col("q").alias("qy"))
        own = at.withColumnRenamed("id", "x")
        pairs = links.withColumn("pull", F.lit(True)).unionByName(drawn(numbered, n, drawn_rows, turn + 1).withColumn("pull", F.lit(False)))
        rows_ = pairs.join(other, "y").join(own, "x").withColumn("dp", F.col("p") - F.col("py")).withColumn("dq", F.col("q") - F.col("qy"))
        rows_ = rows_.withColumn("d", F.col("dp") * F.col("dp") + F.col("dq") * F.col("dq"))
        pull = F.when(F.col("d") > 0, -2 * A * B * F.pow("d", F.lit(B - 1)) / (1 + A * F.pow("d", F.lit(B)))).otherwise(0.0)
        push = 2 * B / ((0.001 + F.col("d")) * (1 + A * F.pow("d", F.lit(B))))
        rows_ = rows_.withColumn("f", F.when(F.col("pull"), pull).otherwise(push))
        # Pulls are a mean over the edges, so that a hub is not torn about; pushes add up.
        moved = rows_.groupBy("x").agg(*[(F.avg(F.when(F.col("pull"), held(F.col("f") * F.col(c)))) + F.sum(F.when(~F.col("pull"), held(F.col("f") * F.col(c))).otherwise(0.0)) / drawn_rows).alias(f"m{c}") for c in ("dp", "dq")])
        at = stored(at.join(moved.withColumnRenamed("x", "id"), "id", "left").select("id", (F.col("p") + step * F.coalesce("mdp", F.lit(0.0))).alias("p"), (F.col("q") + step * F.coalesce("mdq", F.lit(0.0))).alias("q")))
    return at
