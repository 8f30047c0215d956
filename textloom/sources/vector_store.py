"""A stored table of vectors in namespaces: upserts as deltas, exports and imports, label migration under a writer's lock.

Layout of the folder `path`: rows/<part>, each written once, and versions/v=V, a list of parts in order, written last.
Of several rows with one (namespace, id) the one of the latest part counts. A writer creates `path`/lock first, which fails
while another has it, and removes it at the end; a lock that a dead writer left is removed by release().
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.files import migrate

ROW = "namespace string, id string, embedding array<float>, labels array<string>"


def file_of(spark: SparkSession, path: str):
    """The file system of a path and the path, as Hadoop sees them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(conf), file


@contextmanager
def writing(spark: SparkSession, path: str):
    """SRC22: the writer's lock; an error while another writer has it."""
    system, file = file_of(spark, f"{path}/lock")
    if not system.createNewFile(file):
        raise RuntimeError("another writer is at work")
    try:
        yield
    finally:
        system.delete(file, False)


def release(spark: SparkSession, path: str) -> None:
    system, file = file_of(spark, f"{path}/lock")
    system.delete(file, False)


def parts(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The last version and its parts in order."""
    try:
        rows = spark.read.parquet(f"{path}/versions")
        v = rows.agg(F.max("v")).first()[0]
        return v, [r["part"] for r in rows.filter(F.col("v") == v).orderBy("place").collect()]
    except AnalysisException:
        return 0, []


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last version."""
    _, names = parts(spark, path)
    rows = None
    for k, name in enumerate(names):
        part = spark.read.schema(ROW).parquet(f"{path}/rows/{name}").withColumn("place", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return spark.createDataFrame([], ROW)
    if len(names) == 1:
        return rows.drop("place")
    last = F.max_by(F.struct("embedding", "labels"), "place").alias("r")
    return rows.groupBy("namespace", "id").agg(last).select("namespace", "id", "r.embedding", "r.labels")


def add_part(rows: DataFrame, path: str, replace: bool = False) -> None:
    spark = rows.sparkSession
    v, names = parts(spark, path)
    name = uuid.uuid4().hex[:12]
    rows.select("namespace", "id", F.col("embedding").cast("array<float>").alias("embedding"), "labels").write.parquet(f"{path}/rows/{name}")
    listed = [(k, n) for k, n in enumerate([*([] if replace else names), name])]
    spark.createDataFrame(listed, "place int, part string").coalesce(1).write.parquet(f"{path}/versions/v={v + 1}")


def upsert(rows: DataFrame, path: str) -> None:
    """SRC9, SRC10: rows (namespace, id, embedding, labels), ids unique within a namespace, take the place of those with their ids."""
    with writing(rows.sparkSession, path):
        add_part(rows, path)


def merge(spark: SparkSession, path: str) -> None:
    """Writes all parts as one."""
    with writing(spark, path):
        add_part(read(spark, path), path, replace=True)


def export(spark: SparkSession, path: str, to: str) -> int:
    """SRC8: JSON lines of all namespaces; the count of what was written is compared."""
    rows = read(spark, path)
    rows.write.mode("overwrite").json(to)
    n, written = rows.count(), spark.read.schema(ROW).json(to).count()
    if n != written:
        raise ValueError(f"{written} of {n} rows were exported")
    return n


def load(spark: SparkSession, source: str, path: str) -> None:
    """SRC9: imports JSON lines; lines without an id are left out."""
    upsert(spark.read.schema(ROW).json(source).filter("id IS NOT NULL"), path)


def migrate_labels(spark: SparkSession, path: str, stale: dict[str, str], dry_run: bool = False) -> DataFrame:
    """SRC24: rewrites stale labels in every namespace and writes the changed rows only; (namespace, changed) of all namespaces.
    A store without rows is an error; a dry run writes nothing."""
    with writing(spark, path):
        rows = read(spark, path)
        names = rows.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
        if names.isEmpty():
            raise ValueError("the store has no namespaces")
        changed, counts = migrate(rows, stale)
        found = names.join(counts, "namespace", "left").select("namespace", F.coalesce("changed", F.lit(0)).cast("long").alias("changed")).orderBy("namespace").collect()
        if not dry_run and any(r["changed"] for r in found):
            add_part(changed, path)
    return spark.createDataFrame([tuple(r) for r in found], "namespace string, changed long")
