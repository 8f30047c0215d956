"""Streaming operators on Structured Streaming, and their batch twins."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and window; on a stream with a watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """ST4: activity sessions of each user."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def over_limit(events: DataFrame, most: int, width: str = "1 minute") -> DataFrame:
    """ST3: users with more than `most` events in a window."""
    if events.isStreaming:
        events = events.withWatermark("ts", width)
    return events.groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("user_id", F.col("w.start").alias("start"), "n")


def counters(events: DataFrame) -> DataFrame:
    """ST5: running counts by type; on a stream in complete mode."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def budget(events: DataFrame, limit: float, price: float = 0.03) -> DataFrame:
    """ST2: per UTC day, in order of time, a reservation is accepted while the spent sum is under the limit; a fold over the day's events."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    rows = events.groupBy(day).agg(F.array_sort(F.collect_list(F.struct("ts", "kind", "cost"))).alias("e"))
    start = F.struct(F.lit(0.0).alias("spent"), F.lit(0).alias("accepted"), F.lit(0).alias("denied"))

    def step(acc, x):
        ok = F.round(acc["spent"], 6) < limit
        spent = F.when(x["kind"] == "reserve", F.when(ok, acc["spent"] + price).otherwise(acc["spent"])).when(x["kind"] == "reconcile", acc["spent"] - price + x["cost"]).otherwise(acc["spent"] - price)
        taken = (x["kind"] == "reserve") & ok
        return F.struct(spent.alias("spent"), (acc["accepted"] + taken.cast("int")).alias("accepted"), (acc["denied"] + ((x["kind"] == "reserve") & ~ok).cast("int")).alias("denied"))

    out = rows.select("day", F.aggregate("e", start, step).alias("r"))
    return out.select("day", F.round("r.spent", 6).alias("spent"), "r.accepted", "r.denied")


def append_by_day(stream: DataFrame, path: str, checkpoint: str):
    """ST8, SRC15: appends a stream of feedback to Parquet, a folder for each day."""
    return stream.withColumn("day", F.to_date("ts")).writeStream.partitionBy("day").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_items(stream: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """ST1, ST7: items not seen before."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def validated_pairs(stream: DataFrame, path: str, a: str, b: str):
    """ST7: appends the unordered pairs of each micro-batch that were not validated before to `path`/pairs, a folder for each batch;
    a batch that is replayed writes its folder anew."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        pairs = batch.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()
        try:
            known = batch.sparkSession.read.parquet(f"{path}/pairs").filter(F.col("batch") != batch_id)
            pairs = pairs.join(known.select("x", "y"), ["x", "y"], "left_anti")
        except AnalysisException:
            pass  # the first batch
        pairs.write.mode("overwrite").parquet(f"{path}/pairs/batch={batch_id}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
