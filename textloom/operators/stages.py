"""SRC20: stages of a job that are stored, so that a broken run goes on where it ended.

A stage is a function of the rows before it and of its parameters. Its key is a hash of its name, its parameters and the key
before it; the first key is that of the inputs' files. Each result is written to `path`/stages/<name>-<key>, then a row
to `path`/manifest, which counts. A stage whose key is in the manifest is read; another one is written anew, over what
a broken run left. Changed input or parameters give other keys from there on.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.text_index import fingerprint

MANIFEST = "stage string, key string, rows long"
Stage = tuple[str, Callable[..., DataFrame], dict]


def finished(spark: SparkSession, path: str) -> set[str]:
    """The keys of stages whose results are whole."""
    try:
        return {r["key"] for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("key").distinct().collect()}
    except AnalysisException:
        return set()


def keys(first: str, stages: list[Stage]) -> list[str]:
    out = []
    for name, _, parameters in stages:
        first = hashlib.sha1(json.dumps([first, name, parameters], sort_keys=True).encode()).hexdigest()
        out.append(first)
    return out


def run(docs: DataFrame, stages: list[Stage], path: str, version: str = "") -> DataFrame:
    """Applies stages (name, f(rows, **parameters), parameters) one after another to a table of files, and reads the last
    result; `version` names the code, so that its changes count as changed input."""
    spark, rows = docs.sparkSession, docs
    done = finished(spark, path)
    for (name, apply, parameters), key in zip(stages, keys(fingerprint(docs) + version, stages), strict=True):
        folder = f"{path}/stages/{name}-{key}"
        if key not in done:
            apply(rows, **parameters).write.mode("overwrite").parquet(folder)
            n = spark.read.parquet(folder).count()
            spark.createDataFrame([(name, key, n)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
        rows = spark.read.parquet(folder)
    return rows


def progress(spark: SparkSession, docs: DataFrame, stages: list[Stage], path: str, version: str = "") -> DataFrame:
    """(place, stage, finished, rows) of the stages of a run."""
    rows = [(k, name, key) for k, ((name, _, _), key) in enumerate(zip(stages, keys(fingerprint(docs) + version, stages), strict=True))]
    wanted = spark.createDataFrame(rows, "place int, stage string, key string")
    if not finished(spark, path):
        return wanted.select("place", "stage", F.lit(False).alias("finished"), F.lit(None).cast("long").alias("rows"))
    known = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("key", "rows").distinct()
    return wanted.join(known, "key", "left").select("place", "stage", F.col("rows").isNotNull().alias("finished"), "rows")
