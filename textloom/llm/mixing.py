"""Mixing sources to target weights: each source gives a target number of words, by pivotal dependent rounding.

The targets share out `share` of all words by the sources' weights; a target stops at `most` times its source's words and
the excess is shared again by weight. A document of a source then has target / source words fractional copies. Whole
copies are made of them by pivots: two documents pass words between them, one way or the other by chance and so that
expected copies stay as they are, until the copies of one are whole; the other goes on to the next. The words of a source
thus keep their sum, up to the last document, which takes the nearer of its two numbers of copies.

The pivots run in a reduction tree for each source. Its rows are dealt into nodes of about BUCKET rows by a hash of all that
is known of them; a node passes over its documents, the largest first (so that small ones settle it), and leaves one
unsettled document. Each level joins FAN nodes, until one document a source is left. All chances are hashes of the seed
and of the place in the tree, so reruns agree, whatever the partitions.

Scale: of the documents only id, source, words and a hash travel. A hot source has as many more nodes as rows. The driver
holds single rows of totals. A task reads its nodes as a sorted stream and remembers one document.

Defined results: a null or empty text has no words and is taken 0 times; null is a source of its own, the last one; equal
rows are separate documents; with no words at all every target is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import keep, row_key, small, table
from textloom.operators.ranks import ranked

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2
#: Rows of a node, about, and children of a node of the tree.
BUCKET, FAN = 4096, 64

SETTLED = "doc_id long, row_key long, source string, size long, source_size long, target double, copies int, frac double, base int, nodes long, node long"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, row_key, source and the number of words."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), row_key(text_col).alias("row_key"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, n_docs, target: words in proportion to the weights (repeated along the sources in order) up to `most` times
    the source's words, what is above being shared again. Each round is one row of totals; rounds end when no target is cut anew."""
    if share > most:
        raise ValueError("no mix takes more than `most` times all words")
    sources = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = keep(sources.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most).drop("rank"), "sources")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, cut = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * level
        row = sources.agg(F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count(F.when(full, 1)).alias("n")).first()
        if row["n"] == cut or not row["weight"]:
            break
        level, cut = (total - (row["cap"] or 0.0)) / row["weight"], row["n"]
    target = F.col("cap") if level is None or not row["weight"] else F.least(F.col("cap"), F.col("weight") * level)
    return sources.select("source", "source_size", "n_docs", target.alias("target"))


def chance(*what) -> float:
    """A number in [0, 1), fixed by its arguments."""
    return (xxhash.xxh3_64_intdigest(repr(what).encode()) >> 11) / float(1 << 53)


def pivot(a: float, x: float, b: float, y: float, draw: float) -> tuple[float, float]:
    """Words pass between documents of a and b words with fractions x and y of a copy, until one fraction is 0 or 1; the words
    a * x + b * y and the expected fractions stay."""
    up, down = min(a * (1 - x), b * y), min(a * x, b * (1 - y))
    if draw * (up + down) < down:
        return (1.0, max(0.0, y - up / b)) if a * (1 - x) <= b * y else (min(1.0, x + up / a), 0.0)
    return (0.0, min(1.0, y + down / b)) if a * x <= b * (1 - y) else (max(0.0, x - down / a), 1.0)


def settle(batches, seed: int, level: int):
    """Passes over rows sorted by source and node: gives each row its copies, but the last unsettled one of a node."""
    names = [f.split()[0] for f in SETTLED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
    at, held, step = None, None, 0

    def given(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types, strict=True)], names=names)

    for batch in batches:
        out = []
        for row in batch.select(names).to_pylist():
            where = (row["node"], row["source"])
            if where != at:
                out += [held] if held else []
                at, held, step = where, None, 0
            step += 1
            if held is None:
                held = row
            else:
                held["frac"], row["frac"] = pivot(held["size"], held["frac"], row["size"], row["frac"], chance(seed, level, where, step))
                for r in (held, row):
                    if r["frac"] in (0.0, 1.0):
                        r["copies"] = r["base"] + int(r["frac"])
                        out.append(r)
                held = next((r for r in (held, row) if r["copies"] is None), None)
        if out:
            yield given(out)
    if held:
        yield given([held])


def assign(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket: int = BUCKET, fan: int = FAN,
) -> DataFrame:
    """One row per row of docs: doc_id, row_key, source, size, source_size, target and copies."""
    sizes = keep(sized(docs, id_col, text_col, source_col), "words")
    rates = keep(targets(sizes, weights, share, most), "targets")
    rates = F.broadcast(rates) if small(rates) else rates
    rows = sizes.join(rates.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("base", F.floor(rate).cast("int")).withColumn("frac", rate - F.floor(rate))
    whole = (F.col("frac") == 0) | (F.col("size") == 0)
    rows = rows.withColumn("copies", F.when(whole, F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("base"))).cast("int"))
    rows = rows.withColumn("nodes", F.ceil(F.col("n_docs") / bucket)).withColumn("node", F.pmod(F.xxhash64("doc_id", "row_key", F.lit(seed)), F.col("nodes")))
    rows = rows.select(*[f.split()[0] for f in SETTLED.split(", ")])
    helpers = ["frac", "base", "nodes", "node"]
    done, rest, level = [rows.filter("copies IS NOT NULL").drop(*helpers)], rows.filter("copies IS NULL"), 0
    nodes = math.ceil((rates.agg(F.max("n_docs")).first()[0] or 0) / bucket)
    while nodes:
        # The rows of a node stand together in their partition, the largest documents first.
        dealt = rest.repartition("source", "node").sortWithinPartitions("source", "node", F.desc("size"), F.xxhash64("doc_id", "row_key"), "doc_id", "row_key")
        passed = keep(dealt.mapInArrow(lambda b, level=level: settle(b, seed, level), SETTLED), f"pivots{level}")
        left = passed.filter("copies IS NULL")
        nearest = (F.col("base") + F.when(F.col("frac") >= 0.5, 1).otherwise(0)).cast("int")
        done += [passed.filter("copies IS NOT NULL").drop(*helpers), left.filter("nodes = 1").withColumn("copies", nearest).drop(*helpers)]
        rest = left.filter("nodes > 1").withColumn("nodes", F.ceil(F.col("nodes") / fan)).withColumn("node", F.pmod("node", "nodes"))
        nodes, level = math.ceil(nodes / fan) if nodes > 1 else 0, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of docs, each as often as its copies say. Rows that agree in id, text and source count as one
    document, with all their copies; the other columns are those of one of them."""
    copies = assign(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    copies = copies.groupBy(F.col("doc_id").alias("_mix_i"), F.col("row_key").alias("_mix_k"), F.col("source").alias("_mix_s")).agg(F.sum("copies").cast("int").alias("_mix_n"), F.count(F.lit(1)).alias("_mix_c"))
    copies = keep(copies.filter("_mix_n > 0"), "copies")
    own = docs.withColumn("_mix_h", row_key(text_col))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_mix_i")) & (F.col("_mix_h") == F.col("_mix_k")) & F.col(source_col).cast("string").eqNullSafe(F.col("_mix_s"))
    found = own.join(copies, same)
    rows = found.filter("_mix_c = 1").unionByName(found.filter("_mix_c > 1").dropDuplicates(["_mix_i", "_mix_k", "_mix_s"]))
    return rows.withColumn("_mix_n", F.explode(F.array_repeat(F.lit(1), F.col("_mix_n")))).select(*[f"`{c}`" for c in docs.columns])


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source")
