"""Exact places of rows in a global order, without a window over one partition.

Rows are dealt out by ranges of the order and sorted within them; the driver learns one count per range, whose running
sums are the places at which the ranges start. Rows that tie in the order stand in an arbitrary, fixed order: name columns
that tell them apart where that matters. Ranges end within ties too, so a value that a third of the rows share spreads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.graph import stored


def spread_of(df: DataFrame) -> Column:
    """A hash of all columns whose types have one, to cut ranges within ties."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the column `name`: the place of each row in the order, from 0."""
    taken = {c.lower() for c in df.columns}
    spread, place = ("_" * k + x for k, x in ((max(map(len, taken), default=0) + 1, "spread"), (max(map(len, taken), default=0) + 1, "place")))
    rows = df.withColumn(spread, spread_of(df))
    rows = rows.repartitionByRange(*order, F.col(spread)).sortWithinPartitions(*order, F.col(spread)).drop(spread)
    rows = stored(rows.withColumn(place, F.monotonically_increasing_id()))
    # One row per range.
    counts = rows.groupBy(F.shiftright(place, 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, start = {}, 0
    for r in counts:
        before[r["part"]] = start
        start += r["n"]
    starts = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else None
    at = F.lit(0).cast("long") if starts is None else (F.col(place) - F.shiftleft(F.shiftright(place, 33), 33) + F.element_at(starts, F.shiftright(place, 33)))
    return rows.withColumn(name, at.cast("long")).drop(place)


def every_nth(df: DataFrame, order: list[Column], count: int) -> DataFrame:
    """WN10: `count` rows that lie equally far apart in the order, from the first; all rows if there are no more."""
    rows = ranked(df, order, "_rank")
    step = max(1, rows.count() // count)
    return rows.filter((F.col("_rank") % step == 0) & (F.col("_rank") < step * count)).drop("_rank")


def worst(df: DataFrame, order: list[Column], share: float, least: int) -> DataFrame:
    """WN14: the first `share` of all rows in the order, but `least` rows at least."""
    rows = ranked(df, order, "_rank")
    return rows.filter(F.col("_rank") < max(least, int(rows.count() * share))).drop("_rank")


def running(df: DataFrame, group: str, order: list[Column], value: Column) -> DataFrame:
    """df with `pos`, the place of each row in its group, and `sum`, the values of the rows before it. Groups of any size are cut
    into ranges of the order; a window sees one group within one range, and the ranges of a group one row each."""
    rows = df.withColumn("_value", value.cast("long")).withColumn("_spread", spread_of(df))
    rows = rows.repartitionByRange(F.col(group), *order, F.col("_spread")).sortWithinPartitions(F.col(group), *order, F.col("_spread")).drop("_spread")
    rows = stored(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    parts = rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_value").alias("_v"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(group).alias("_g"), "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_v"))
    near = Window.partitionBy(group, "_part").orderBy("_at")
    rows = rows.withColumn("_pos", F.row_number().over(near) - 1).withColumn("_sum", F.sum("_value").over(near) - F.col("_value"))
    found = rows.join(parts.withColumnRenamed("_part", "_p"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return found.select(*df.columns, (F.col("_pos") + F.col("_n")).cast("long").alias("pos"), (F.col("_sum") + F.col("_v")).cast("long").alias("sum"))
