"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Two texts are equal when they are identical after every blank ([\\x20\\x09-\\x0D]) is deleted; null counts as empty.
Of equal rows the one with the most code points in its original text stays, then the one with the smallest doc_id
(null last); of rows that agree in both, any one.

Stages: (1) the map side of the first aggregation folds the rows of its own partition; (2) its reduce side merges
digest groups within a salt, so a group of any size is spread over SALTS tasks; (3) the winners of the salts, at most
SALTS a group, are combined. The grouping key of every stage holds the whole normalised text beside its digest, so
contents and not just digests are compared. After that only digests travel; digests with several contents (collisions)
are found exactly, and their rows, if there are any, are matched by content.

Defined results: null and empty texts form one group; an empty table gives an empty result; other columns of the input
are not read by `decisions` and pass through `deduplicated` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from textloom.llm.common import BLANKS, fresh, keep, table

SALTS = 16
#: A group with over 1/HEAVY of all rows is heavy; so there are fewer than HEAVY heavy groups.
HEAVY = 1000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: digest, norm, winner (n_cp, complement of doc_id), group_size."""
    rows = docs.select(
        normalised(F.col(text_col)).alias("norm"),
        F.struct(F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_cp"), F.bitwise_not(F.col(id_col)).alias("neg")).alias("w"),
        F.pmod(F.xxhash64(F.col(id_col), F.length(F.col(text_col))), F.lit(salts)).cast("int").alias("salt"),
    ).withColumn("digest", digest(F.col("norm")))
    salted = rows.groupBy("digest", "norm", "salt").agg(F.max("w").alias("w"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "norm").agg(F.max("w").alias("winner"), F.sum("n").alias("group_size"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> tuple[DataFrame, DataFrame | None]:
    """Groups by digest (digest, keep_id, keep_cp, group_size), and those of colliding digests with their norm."""
    found = winners(docs, id_col, text_col, digest, salts)
    narrow = keep(found.select("digest", F.bitwise_not(F.col("winner.neg")).alias("keep_id"), F.col("winner.n_cp").alias("keep_cp"), "group_size"), "groups")
    collided = narrow.groupBy("digest").count().filter("count > 1").select("digest")
    if collided.isEmpty():
        return narrow, None
    collided = keep(collided, "collided")
    by_text = found.join(collided, "digest", "left_semi").select("digest", "norm", F.bitwise_not(F.col("winner.neg")).alias("keep_id"), F.col("winner.n_cp").alias("keep_cp"), "group_size")
    return narrow.join(collided, "digest", "left_anti"), by_text


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256. Exactly one row of a group is kept."""
    by_digest, by_text = groups(docs, id_col, text_col, digest, salts)
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_cp"), digest(norm).alias("digest"), F.sha2(norm, 256).alias("text_sha256"))
    joined = rows.join(by_digest, "digest")
    if by_text is not None:
        odd = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_cp"), norm.alias("norm")).withColumn("digest", digest(F.col("norm"))).withColumn("text_sha256", F.sha2("norm", 256))
        joined = joined.unionByName(odd.join(by_text, ["digest", "norm"]).drop("norm").select(joined.columns))
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp"))
    # Only rows with one id and one text can tie, so these windows are as large as an id is repeated.
    tie = Window.partitionBy("doc_id", "text_sha256").orderBy(F.desc("n_cp"))
    return joined.withColumn("kept", best & (F.row_number().over(tie) == 1)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows of heavy groups are settled where they are read, against a broadcast of fewer than HEAVY rows; the others are
    joined by digest, where no group holds over 1/HEAVY of all rows.
    """
    by_digest, by_text = groups(docs, id_col, text_col, digest, salts)
    d, k, c, n, x, g = (fresh(docs, f"_dedup_{s}") for s in ("digest", "keep", "cp", "norm", "heavy", "size"))
    total = by_digest.agg(F.sum("group_size")).first()[0] or 0
    least = max(2, total // HEAVY)
    length = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    rows = docs.withColumn(d, digest(normalised(F.col(text_col))))
    named = by_digest.select(F.col("digest").alias(d), F.col("keep_id").alias(k), F.col("keep_cp").alias(c), F.col("group_size").alias(g))
    # Every heavy group has over total / HEAVY rows, so this broadcast has at most HEAVY rows of 60 bytes.
    heavy = named.filter(F.col(g) > least).drop(g).withColumn(x, F.lit(True))
    marked = rows.join(F.broadcast(heavy), d, "left")
    best = F.col(id_col).eqNullSafe(F.col(k)) & (length == F.col(c))
    settled = marked.filter(F.col(x) & best).drop(k, c, x)
    light = marked.filter(F.col(x).isNull()).drop(k, c, x).join(named.filter(F.col(g) <= least).drop(g), d).filter(best).drop(k, c)
    stay = settled.unionByName(light).dropDuplicates([d])
    if by_text is not None:
        odd = by_text.select(F.col("digest").alias(d), F.col("norm").alias(n), F.col("keep_id").alias(k), F.col("keep_cp").alias(c))
        stay = stay.unionByName(rows.withColumn(n, normalised(F.col(text_col))).join(odd, [d, n]).filter(best).dropDuplicates([n]).drop(n, k, c))
    return stay.select(*[F.col(f"`{name}`") for name in docs.columns])


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
    FROM documents
), w AS (
    SELECT doc_id, n_cp, norm, count(*) OVER (PARTITION BY norm) AS group_size,
           first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id ASC NULLS LAST) AS keep_id,
           row_number() OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id ASC NULLS LAST) AS place
    FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM w
"""
