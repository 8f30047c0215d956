import random

from pyspark.sql import functions as F

from textloom.operators.ranks import ranked


def test_ranks_are_places_in_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), i) for i in range(500)] + [(2, 7)] * 900
    df = spark.createDataFrame(rows, "a int, b long").repartition(7)
    out = ranked(df, [F.col("a").asc_nulls_last(), F.col("b").desc()], "place").orderBy("place").collect()
    assert [r.place for r in out] == list(range(len(rows)))
    assert [(r.a, r.b) for r in out] == sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -r[1]))
    assert ranked(df.limit(0), [F.col("a")]).count() == 0


def test_one_value_spreads_over_ranges(spark):
    df = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").alias("rank"), F.lit(1).alias("_rank"))
    out = ranked(df, [F.col("k")], "at")
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan
    assert sorted(r[0] for r in out.select("at").collect()) == list(range(40_000))
