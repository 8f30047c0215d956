"""Joins over time within groups: segments with the label that overlaps them most, and the nearest point to a time.

Neither needs the rows of a group in one task. Intervals meet in bins of time, a pair in the bin where its overlap begins.
Points and probes stand in one sorted order that is cut into ranges; what lies beyond a range's ends comes from one row for
each group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.graph import stored

UNKNOWN = "SPEAKER_UNKNOWN"


def bin_width(segments: DataFrame, turns: DataFrame) -> float:
    """Four mean lengths: all intervals together then lie in no more bins than 1.25 times their number, and one each."""
    lengths = segments.select((F.col("end") - F.col("start")).alias("d")).unionByName(turns.select((F.col("end") - F.col("start")).alias("d"))).filter("d > 0")
    mean = lengths.agg(F.avg("d")).first()[0]
    return 4.0 * mean if mean else 1.0


def binned(rows: DataFrame, width: float) -> DataFrame:
    first, last = F.floor(F.col("start") / width), F.floor(F.col("end") / width)
    return rows.filter(F.col("end") > F.col("start")).withColumn("bin", F.explode(F.sequence(first, F.greatest(first, last))))


def overlaps(segments: DataFrame, turns: DataFrame, group: str, width: float | None = None) -> DataFrame:
    """(id, label, seconds) of segments (group, id, start, end) and turns (group, label, start, end): how long the turns of a
    label overlap a segment, ends excluded; only pairs that overlap. Turns of one label count one by one."""
    width = width or bin_width(segments, turns)
    a = binned(segments.select(group, "id", "start", "end"), width)
    b = binned(turns.select(group, "label", F.col("start").alias("from"), F.col("end").alias("to"), F.col("start"), F.col("end")), width).drop("start", "end")
    begin = F.greatest("start", "from")
    # A pair has rows in every bin that both touch; the bin in which the overlap begins counts.
    pairs = a.join(b, [group, "bin"]).filter((F.col("from") < F.col("end")) & (F.col("start") < F.col("to")) & (F.floor(begin / width) == F.col("bin")))
    return pairs.groupBy("id", "label").agg(F.sum(F.least("end", "to") - begin).alias("seconds"))


def dominant(segments: DataFrame, turns: DataFrame, group: str, width: float | None = None, digits: int = 9) -> DataFrame:
    """JN15: (id, label, seconds): the label that overlaps each segment longest (ties: the first label; seconds are rounded for
    that), SPEAKER_UNKNOWN where none does. Ids of segments are unique."""
    found = overlaps(segments, turns, group, width)
    best = found.groupBy("id").agg(F.min(F.struct((-F.round("seconds", digits)).alias("s"), F.col("label"))).alias("b"))
    out = segments.select("id").join(best, "id", "left")
    return out.select("id", F.coalesce("b.label", F.lit(UNKNOWN)).alias("label"), F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("seconds"))


def either(last: Column, after: Column, t: Column) -> Column:
    """Of the points before and after t the nearer; of equally near ones that of the smaller id."""
    back, ahead = t - last["t"], after["t"] - t
    return F.when(after.isNull() | (back < ahead) | ((back == ahead) & (last["pid"] <= after["pid"])), last).otherwise(after)


def asof(probes: DataFrame, points: DataFrame, group: str, direction: str = "nearest", tolerance: float | None = None) -> DataFrame:
    """JN16: probes (group, id, t) with the nearest point (group, pid, t) of their group: id, pid, distance; by the last at or
    before t ("backward"), the next at or after it ("forward") or the nearer of both (ties: the smaller pid). No row is lost:
    without a point, or with none within the tolerance, pid is null. Points without a time are nowhere; the probes' ids may repeat."""
    if direction not in ("nearest", "backward", "forward"):
        raise ValueError(f"no such direction: {direction}")
    known = points.filter(F.col("t").isNotNull() & F.col(group).isNotNull()).select(group, "t", "pid")
    asked = probes.filter(F.col("t").isNotNull() & F.col(group).isNotNull()).select(group, "t", F.lit(None).cast(known.schema["pid"].dataType).alias("pid"))
    keys = known.unionByName(asked).groupBy(group, "t").agg(F.min("pid").alias("pid"))
    keys = stored(keys.repartitionByRange(group, "t").withColumn("part", F.spark_partition_id()))
    point = F.when(F.col("pid").isNotNull(), F.struct("t", "pid"))

    # Within a range of the order: the points before and after, by two passes that each look back only.
    near = Window.partitionBy("part", group)
    rows = keys.withColumn("last", F.last(point, True).over(near.orderBy("t"))).withColumn("after", F.last(point, True).over(near.orderBy(F.desc("t"))))
    # Beyond it: one row for each group and range, so as many for a group as there are ranges.
    ends = keys.groupBy(group, "part").agg(F.min(point).alias("first"), F.max(point).alias("final"))
    parts = Window.partitionBy(group)
    ends = ends.withColumn("before", F.last("final", True).over(parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("beyond", F.last("first", True).over(parts.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(ends.filter("before IS NOT NULL OR beyond IS NOT NULL").select(group, "part", "before", "beyond"), [group, "part"], "left")
    last, after = F.coalesce("last", "before"), F.coalesce("after", "beyond")
    rows = rows.select(group, "t", last.alias("last"), after.alias("after"))
    best = {"backward": F.col("last"), "forward": F.col("after"), "nearest": F.when(F.col("last").isNull(), F.col("after")).otherwise(either(F.col("last"), F.col("after"), F.col("t")))}[direction]
    found = rows.select(group, "t", best.alias("p")).filter("p IS NOT NULL")
    out = probes.select(group, "id", "t").join(found, [group, "t"], "left")
    distance = F.abs(F.col("p.t").cast("double") - F.col("t").cast("double"))
    near_enough = F.lit(True) if tolerance is None else distance <= tolerance
    return out.select("id", F.when(near_enough, F.col("p.pid")).alias("pid"), F.when(near_enough, distance).alias("distance"))
