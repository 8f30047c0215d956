"""ON3: domains of relation names that evolve with each batch of names, as a versioned table.

A batch is decided against the version before it. A name that is known adds to its domain's frequency. A new name joins the
nearest domain if their cosine is `same` or more, and the domain's centroid becomes the mean of all members; at `related` or
more it opens a domain below the nearest one; else a domain of its own. Then domains whose centroids have a cosine of `merge`
or more are merged: linked ones become one, the oldest, with all members. With one name a batch this is the sequential
method; names of one batch that are near each other meet in the mergers.

Layout of the folder `path`: domains/v=V, members/v=V, log/v=V, and versions/v=V, one row (v, batch, next) that is written
last. A batch whose version was not written leaves nothing behind that counts; a batch that was, is not applied again. Only
the last two versions need to stay.

Defined results: names without a vector, or with one of no length, are skipped; a name that occurs several times in a
batch counts as often; of several vectors of a name the least is taken.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import ranks
from textloom.operators.graph import connected_components, stored
from textloom.operators.vectors import nearest, product_pairs, unit

SAME, RELATED, MERGE = 0.7, 0.5, 0.85
DOMAINS = "domain long, name string, parent long, n long, frequency long, total array<double>"
MEMBERS = "name string, domain long, vector array<double>"


def state(spark: SparkSession, path: str) -> tuple[int, int, int, DataFrame, DataFrame]:
    """The last version: its number, its batch, the next domain's number, domains and members."""
    try:
        rows = spark.read.parquet(f"{path}/versions")
        last = rows.orderBy(F.desc("v")).first()
    except AnalysisException:
        last = None
    if last is None:
        return 0, -1, 0, spark.createDataFrame([], DOMAINS), spark.createDataFrame([], MEMBERS)
    read = lambda part, schema: spark.read.schema(schema).parquet(f"{path}/{part}/{last['folder']}")
    return last["v"], last["batch"], last["next"], read("domains", DOMAINS), read("members", MEMBERS)


def summed(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, total): the number and the sum of the vectors of each key."""
    parts = rows.select(key, F.posexplode("vector").alias("k", "x")).groupBy(key, "k").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    # One entry per dimension, so the lists are as long as a vector.
    made = parts.groupBy(key).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "x"))).alias("l"))
    return made.select(key, "n", F.transform("l", lambda e: e["x"]).alias("total"))


def centroids(domains: DataFrame) -> DataFrame:
    return domains.select(F.col("domain").alias("id"), unit(F.col("total")).alias("u")).filter("u IS NOT NULL")


def merged(domains: DataFrame, members: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Domains and members after merging, and (domain, into) of the domains that went."""
    pairs = product_pairs(centroids(domains), least)
    into = stored(connected_components(pairs.select(F.col("x").alias("src"), F.col("y").alias("dst"), F.lit("near").alias("type"))).select(F.col("id").alias("domain"), F.col("component").alias("into")).filter("domain <> into"))
    if into.isEmpty():
        return domains, members, into
    moved = lambda df: df.join(into, "domain", "left").withColumn("to", F.coalesce("into", "domain"))
    own = domains.select("domain", "name", "parent")
    counts = moved(domains).groupBy(F.col("to").alias("domain")).agg(F.sum("n").alias("n"), F.sum("frequency").alias("frequency"))
    totals = summed(moved(domains).select(F.col("to").alias("domain"), F.col("total").alias("vector")), "domain").select("domain", "total")
    parents = into.select(F.col("domain").alias("parent"), F.col("into").alias("above"))
    # A parent that was merged is replaced by what took it in; a domain is no parent of itself.
    kept = own.join(counts, "domain").join(totals, "domain").join(parents, "parent", "left").withColumn("parent", F.coalesce("above", "parent"))
    kept = kept.withColumn("parent", F.when(F.col("parent") != F.col("domain"), F.col("parent")))
    return kept.select("domain", "name", "parent", "n", "frequency", "total"), moved(members).select("name", F.col("to").alias("domain"), "vector"), into


def evolve(batch: DataFrame, path: str, batch_id: int, same: float = SAME, related: float = RELATED, merge: float = MERGE) -> bool:
    """Applies a batch of rows (name, vector) to the domains at `path`; false if this batch was applied before."""
    spark = batch.sparkSession
    version, last, following, domains, members = state(spark, path)
    if batch_id <= last:
        return False
    rows = batch.select("name", F.col("vector").cast("array<double>").alias("vector")).filter("name IS NOT NULL").filter(unit(F.col("vector")).isNotNull())
    names = stored(rows.groupBy("name").agg(F.min("vector").alias("vector"), F.count(F.lit(1)).alias("times")))
    known = names.join(members.select("name", "domain"), "name").select("domain", "times")
    new = stored(names.join(members.select("name"), "name", "left_anti"))
    found = nearest(new.select(F.col("name").alias("id"), unit(F.col("vector")).alias("u")), centroids(domains))
    new = new.join(found.withColumnRenamed("id", "name"), "name", "left")
    action = F.when(F.col("cosine") >= same, "assigned").when(F.col("cosine") >= related, "subdomain_created").otherwise("new_domain")
    new = stored(new.withColumn("action", action))

    joined = new.filter("action = 'assigned'").select("name", F.col("target").alias("domain"), "vector", "times")
    opened = ranks.ranked(new.filter("action <> 'assigned'"), [F.col("name")], "place")
    opened = stored(opened.select("name", (F.col("place") + following).alias("domain"), F.when(F.col("action") == "subdomain_created", F.col("target")).alias("parent"), "vector", "times"))
    # A new name counts once when it is placed and again for each further time that it occurs.
    heard = known.unionByName(joined.select("domain", "times")).groupBy("domain").agg(F.sum("times").alias("more"))
    gains = summed(joined.select("domain", "vector"), "domain").select("domain", F.col("n").alias("gained"), F.col("total").alias("gain"))
    grown = domains.join(heard, "domain", "left").join(gains, "domain", "left").select(
        "domain", "name", "parent", (F.col("n") + F.coalesce("gained", F.lit(0))).alias("n"), (F.col("frequency") + F.coalesce("more", F.lit(0))).alias("frequency"),
        F.when(F.col("gain").isNull(), F.col("total")).otherwise(F.zip_with("total", "gain", lambda a, b: a + b)).alias("total"),
    )
    fresh = opened.select("domain", "name", "parent", F.lit(1).cast("long").alias("n"), F.col("times").alias("frequency"), F.col("vector").alias("total"))
    all_members = members.unionByName(joined.select("name", "domain", "vector")).unionByName(opened.select("name", "domain", "vector"))
    kept, placed, into = merged(stored(grown.unionByName(fresh)), stored(all_members), merge)

    folder = f"v{version + 1}-{uuid.uuid4().hex[:8]}"
    kept.write.parquet(f"{path}/domains/{folder}")
    placed.write.parquet(f"{path}/members/{folder}")
    log = new.select("name", "action", F.col("target").alias("domain"), "cosine").unionByName(into.select(F.col("into").cast("string").alias("name"), F.lit("merged").alias("action"), "domain", F.lit(None).cast("double").alias("cosine")))
    log.withColumn("batch", F.lit(batch_id).cast("long")).write.parquet(f"{path}/log/{folder}")
    ending = spark.createDataFrame([(version + 1, batch_id, following + opened.count(), folder)], "v long, batch long, next long, folder string")
    ending.coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return True


def run(stream: DataFrame, path: str, **how):
    """Evolves the domains with each micro-batch of a stream of names; a batch that is replayed changes nothing."""
    apply = lambda batch, batch_id: evolve(batch, path, batch_id, **how)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
