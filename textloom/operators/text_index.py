"""A stored inverted index: postings in term buckets with block maxima, exact top-k by pruning blocks, deltas and merging.

Layout of the folder `path`:

    postings/gen=G/bucket=B   term, block, n, max_tf, min_dl, entries (doc_id, tf, dl); sorted by term and block
    terms/gen=G/bucket=B      term, df
    docs/gen=G                doc_id, dl, block
    versions/v=V              one row a generation: gen, n, total_dl, buckets; and the mean idf of all terms

A generation is a set of documents that were indexed together. Its documents stand in the order of their length and are cut
into blocks of BLOCK, so the bounds of a block (largest tf of a term, shortest document) are tight. A version is written
last and names the generations that count; what a broken run left behind is in no version. append() adds a generation,
merge() writes all of them as one from their postings, without reading the texts again.

A search reads the buckets of its terms only. It scores the blocks with the highest bounds first; the k-th score found is
the threshold for the bounds of all others, and only blocks that reach it are read. The result is exact.

Building: a document's terms are counted where it is read; whole documents travel to their block, and blocks to their bucket.
Scale: blocks of a common term spread over files by slices of the documents; the driver learns sums, the terms of the query and one threshold.
Defined results: documents without terms are indexed with length 0; ids are unique, append() skips those that the index has;
a query without terms gives no rows; texts that are null count as empty.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import ranks
from textloom.operators.graph import shared_folder, stored
from textloom.operators.search import B, EPSILON, K1, tokens

#: Documents of a block, and folders of terms.
BLOCK, BUCKETS = 256, 32
#: Blocks of one bucket that are written by one task, and documents whose postings one task makes, about.
SLICE, TASK = 256, 4096
#: Blocks that are scored first, to learn the threshold.
FIRST = 8
#: Scores this far below the threshold are still read, so that rounding can't part what it makes equal.
SLACK = 1e-5


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def part_of(spark: SparkSession, path: str, part: str, generations: list[str]) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{part}").parquet(*[f"{path}/{part}/gen={g}" for g in generations])


@dataclass(frozen=True)
class Index:
    """An opened version: its generations, those of them that have words, and statistics."""

    spark: SparkSession
    path: str
    generations: list[str]
    worded: list[str]
    n: int
    total_dl: int
    mean_idf: float
    buckets: int

    @property
    def average(self) -> float:
        return self.total_dl / self.n if self.n else 0.0

    def read(self, part: str) -> DataFrame:
        return part_of(self.spark, self.path, part, self.generations if part == "docs" else self.worded)

    def of_terms(self, part: str, terms: list[str]) -> DataFrame:
        """The rows of some terms; other buckets are not opened."""
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"), self.buckets).alias("b"))
        numbers = sorted({r["b"] for r in wanted.collect()})
        return self.read(part).filter(F.col("bucket").isin(numbers) & F.col("term").isin(terms))


def open_index(spark: SparkSession, path: str) -> Index | None:
    """The last version of the index, None if there is none."""
    try:
        rows = spark.read.parquet(f"{path}/versions")
    except AnalysisException:
        return None
    last = rows.filter(F.col("v") == rows.agg(F.max("v")).first()[0]).collect()
    if not last:
        return None
    return Index(spark, path, sorted(r["gen"] for r in last if r["n"]), sorted(r["gen"] for r in last if r["total_dl"]), sum(r["n"] for r in last), sum(r["total_dl"] for r in last), last[0]["mean_idf"], last[0]["buckets"])


def write_version(spark: SparkSession, path: str, generations: list[tuple[str, int, int]], buckets: int, version: int) -> None:
    """Writes a version of generations (name, documents, words), with the mean idf of their terms."""
    n, mean = sum(g[1] for g in generations), 0.0
    names = [g[0] for g in generations if g[2]]
    if names:
        df = part_of(spark, path, "terms", names).groupBy("term").agg(F.sum("df").alias("df"))
        mean = df.agg(F.avg(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))).first()[0] or 0.0
    rows = [(*g, buckets, float(mean)) for g in generations]
    spark.createDataFrame(rows, "gen string, n long, total_dl long, buckets int, mean_idf double").coalesce(1).write.parquet(f"{path}/versions/v={version}")


def last_version(spark: SparkSession, path: str) -> tuple[int, list[tuple[str, int, int]]]:
    try:
        rows = spark.read.parquet(f"{path}/versions")
    except AnalysisException:
        return 0, []
    v = rows.agg(F.max("v")).first()[0]
    return v, [(r["gen"], r["n"], r["total_dl"]) for r in rows.filter(F.col("v") == v).collect()]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, dl, block, terms, tfs) in the order of block and id as rows (term, block, n, max_tf, min_dl, entries)."""

    def rows(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        ids, dl = whole["doc_id"].combine_chunks(), whole["dl"].to_numpy()
        doc = np.repeat(np.arange(len(dl)), pc.list_value_length(whole["terms"]).to_numpy())
        coded = pc.list_flatten(whole["terms"]).combine_chunks().dictionary_encode()
        codes, tf = coded.indices.to_numpy(), pc.list_flatten(whole["tfs"]).to_numpy()
        if not len(codes):
            return
        order = np.argsort(codes, kind="stable")
        doc, tf = doc[order], tf[order]
        n = np.bincount(codes)
        at = np.r_[0, np.cumsum(n)]
        entries = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(tf), pa.array(dl[doc])], names=["doc_id", "tf", "dl"])
        block = pa.array(np.full(len(n), whole["block"][0].as_py()))
        columns = [coded.dictionary, block, pa.array(n), pa.array(np.maximum.reduceat(tf, at[:-1])), pa.array(np.minimum.reduceat(dl[doc], at[:-1])), pa.ListArray.from_arrays(pa.array(at, pa.int32()), entries)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "block", "n", "max_tf", "min_dl", "entries"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        starts = np.flatnonzero(np.r_[len(block) > 0, block[1:] != block[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(block)], strict=True):
            if held and held[0].column("block")[0].as_py() != block[a]:
                yield from rows(held)
                held = []
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield from rows(held)


def write_generation(sized: DataFrame, words: DataFrame, path: str, block: int, buckets: int) -> tuple[str, int, int]:
    """Writes documents (doc_id, dl) and their distinct terms (doc_id, dl, terms, tfs) as a new generation."""
    gen = f"g{uuid.uuid4().hex[:12]}"
    placed = ranks.ranked(sized, [F.col("dl"), F.col("doc_id")], "place")
    placed.select("doc_id", "dl", F.floor(F.col("place") / block).alias("block")).write.parquet(f"{path}/docs/gen={gen}")
    docs = sized.sparkSession.read.parquet(f"{path}/docs/gen={gen}")
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words")).first()
    if total["words"]:
        # Whole documents travel to their block, so a block's postings (at most `block` entries a row) are made in one task.
        rows = words.join(docs.select("doc_id", "block"), "doc_id").select("doc_id", "dl", "block", "terms", "tfs")
        rows = rows.repartition(-(-total["n"] // TASK), "block").sortWithinPartitions("block", "doc_id")
        kind = rows.schema["doc_id"].dataType.simpleString()
        rows = rows.mapInArrow(grouped, f"term string, block long, n long, max_tf long, min_dl long, entries array<struct<doc_id: {kind}, tf: long, dl: long>>")
        # A bucket's blocks are dealt out by slices of the documents, so a common term spreads; tasks grow with the slices.
        slices = -(-total["n"] // (block * SLICE))
        rows = rows.withColumn("bucket", bucket_of(F.col("term"), buckets)).withColumn("slice", F.floor(F.col("block") / SLICE))
        rows = rows.repartition("bucket", "slice") if slices == 1 else rows.repartition(buckets * slices, "bucket", "slice")
        rows.drop("slice").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings/gen={gen}")
        terms = docs.sparkSession.read.parquet(f"{path}/postings/gen={gen}")
        terms.groupBy("bucket", "term").agg(F.sum("n").alias("df")).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms/gen={gen}")
    return gen, total["n"], total["words"] or 0


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, toks) as (doc_id, dl, terms, tfs), some at a time."""
    for whole in batches:
        for start in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(start, BLOCK)
            dl = pc.list_value_length(batch.column("toks")).to_numpy().astype(np.int64)
            coded = batch.column("toks").flatten().dictionary_encode()
            size = max(1, len(coded.dictionary))
            keys, tfs = np.unique(np.repeat(np.arange(len(dl)), dl) * size + coded.indices.to_numpy(), return_counts=True)
            at = pa.array(np.searchsorted(keys, np.arange(len(dl) + 1) * size), pa.int32())
            terms = pa.ListArray.from_arrays(at, coded.dictionary.take(pa.array(keys % size)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(dl), terms, pa.ListArray.from_arrays(at, pa.array(tfs))], names=["doc_id", "dl", "terms", "tfs"])


def tokenised(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, dl) of each document and (doc_id, dl, terms, tfs), its distinct terms and their counts, from one pass over the texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("toks"))
    rows = stored(rows.mapInArrow(counted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, dl long, terms array<string>, tfs array<long>"))
    return rows.select("doc_id", "dl"), rows


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, buckets: int = BUCKETS) -> Index:
    """RK1, SRC11: a new version of the index at `path` that holds these documents only."""
    spark = docs.sparkSession
    version, _ = last_version(spark, path)
    gen = write_generation(*tokenised(docs, id_col, text_col), path, block, buckets)
    write_version(spark, path, [gen], buckets, version + 1)
    return open_index(spark, path)


def append(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> Index:
    """Adds the documents whose ids the index doesn't have, as a generation of their own."""
    spark = docs.sparkSession
    index = open_index(spark, path)
    if index is None:
        return build(docs, path, id_col, text_col, block)
    version, generations = last_version(spark, path)
    new = docs.join(index.read("docs").select(F.col("doc_id").alias(id_col)), id_col, "left_anti") if index.generations else docs
    gen = write_generation(*tokenised(new, id_col, text_col), path, block, index.buckets)
    write_version(spark, path, [*generations, gen], index.buckets, version + 1)
    return open_index(spark, path)


def merge(spark: SparkSession, path: str, block: int = BLOCK) -> Index:
    """Writes all generations as one; the texts are not needed."""
    index = open_index(spark, path)
    version, generations = last_version(spark, path)
    if len(generations) < 2 or not index.worded:
        return index
    entries = index.read("postings").select("term", F.explode("entries").alias("e")).select("e.doc_id", "e.dl", F.struct("term", "e.tf").alias("t"))
    words = entries.groupBy("doc_id", "dl").agg(F.collect_list("t").alias("t")).select("doc_id", "dl", F.col("t.term").alias("terms"), F.col("t.tf").alias("tfs"))
    gen = write_generation(index.read("docs").select("doc_id", "dl"), words, path, block, index.buckets)
    write_version(spark, path, [gen], index.buckets, version + 1)
    return open_index(spark, path)


def weights(index: Index, terms: list[str], epsilon: float = EPSILON) -> dict[str, float]:
    """The idf of each term of the query that the index has, times its occurrences; a negative idf becomes epsilon times the mean."""
    wanted = Counter(terms)
    if not wanted or not index.worded:
        return {}
    df = index.of_terms("terms", list(wanted)).groupBy("term").agg(F.sum("df").alias("df"))
    idf = df.select("term", F.log((F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return {r["term"]: wanted[r["term"]] * (r["idf"] if r["idf"] >= 0 else epsilon * index.mean_idf) for r in idf.collect()}


def impact(index: Index, w: dict[str, float], tf: Column, dl: Column, k1: float, b: float) -> Column:
    """What a term adds to a document's score."""
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in w.items() for x in pair]), F.col("term"))
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / index.average))


def blocks_of(index: Index, w: dict[str, float], k1: float, b: float) -> DataFrame:
    """(gen, block, bound): what no document of a block exceeds; the entries are not read."""
    heads = index.of_terms("postings", list(w)).select("gen", "term", "block", F.greatest(F.lit(0.0), impact(index, w, F.col("max_tf"), F.col("min_dl"), k1, b)).alias("bound"))
    return heads.groupBy("gen", "block").agg(F.sum("bound").alias("bound"))


def scored(index: Index, w: dict[str, float], rows: DataFrame, k1: float, b: float) -> DataFrame:
    """(doc_id, score) of the entries of posting rows."""
    hits = rows.select("term", F.explode("entries").alias("e"))
    return hits.groupBy("e.doc_id").agg(F.sum(impact(index, w, F.col("e.tf"), F.col("e.dl"), k1, b)).alias("score")).filter("score > 0")


def nothing(index: Index) -> DataFrame:
    return index.spark.createDataFrame([], "doc_id long, score double")


def scores(index: Index, terms: list[str], k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """(doc_id, score > 0) of all documents, from the postings of the terms."""
    w = weights(index, terms, epsilon)
    return scored(index, w, index.of_terms("postings", list(w)), k1, b) if w else nothing(index)


def reaching(index: Index, w: dict[str, float], k: int, k1: float = K1, b: float = B, first: int = FIRST) -> DataFrame:
    """(gen, block, bound) of the blocks that can hold one of the k best documents."""
    bounds = stored(blocks_of(index, w, k1, b))
    best = bounds.orderBy(F.desc("bound"), "gen", "block").limit(max(first, 2 * -(-k // BLOCK))).select("gen", "block")
    known = scored(index, w, index.of_terms("postings", list(w)).join(F.broadcast(best), ["gen", "block"], "left_semi"), k1, b)
    # k rows; one threshold comes to the driver.
    low = known.orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).first()
    return bounds.filter(F.col("bound") >= low["low"] - SLACK) if low["n"] == k else bounds


def search(index: Index, terms: list[str], k: int, k1: float = K1, b: float = B, epsilon: float = EPSILON, first: int = FIRST) -> DataFrame:
    """RK2: (doc_id, score) of a superset of the k best documents, which blocks below the k-th score are not part of; take
    the top by the order of your choice."""
    w = weights(index, terms, epsilon)
    if not w:
        return nothing(index)
    left = reaching(index, w, k, k1, b, first).select("gen", "block")
    return scored(index, w, index.of_terms("postings", list(w)).join(left, ["gen", "block"], "left_semi"), k1, b)


def tf_scores(index: Index, terms: list[str], min_frequency: int = 1) -> DataFrame:
    """RK4: (doc_id, score, matched): sum of tf / words of the document over the query's terms, repeated terms counting again."""
    wanted = Counter(terms)
    if not wanted or not index.worded:
        return nothing(index).withColumn("matched", F.lit(0).cast("long"))
    times = F.element_at(F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair]), F.col("term"))
    hits = index.of_terms("postings", list(wanted)).select("term", F.explode("entries").alias("e")).filter(F.col("e.tf") >= min_frequency)
    return hits.groupBy("e.doc_id").agg(F.sum(times * F.col("e.tf") / F.col("e.dl")).alias("score"), F.count(F.lit(1)).alias("matched"))


def fingerprint(docs: DataFrame) -> str:
    """A hash of the files that a table is read from: paths, sizes and times; their contents are not read."""
    file = F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    return docs.select(file.alias("f")).distinct().agg(F.sha1(F.concat_ws("\n", F.array_sort(F.collect_list(F.col("f").cast("string")))))).first()[0]


def index_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of a table of files, kept in the shared folder under its fingerprint; built if it is not there yet."""
    path = f"{shared_folder(docs.sparkSession)}/index-{fingerprint(docs)}-{id_col}-{text_col}"
    return open_index(docs.sparkSession, path) or build(docs, path, id_col, text_col)
