"""Queries of file sources and sinks: the tables are written as the files that a source reads, and read by it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import chunking
from textloom.operators.graph import shared_folder
from textloom.plans.catalogue import query
from textloom.sources import files, vector_store
from textloom.sources.tables import table


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def json_files(rows, path, per_file=100):
    """One JSON array of at most `per_file` objects a file, all files in one folder; rows (k, o)."""
    lists = rows.groupBy(F.floor(F.col("k") / per_file).alias("file")).agg(F.to_json(F.sort_array(F.collect_list("o"))).alias("value"))
    # A folder for each file would have to be listed and opened by itself.
    lists.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file").select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("episode_files", "SELECT CAST(doc_id AS VARCHAR) AS episode_number, source AS title, length(text) AS letters FROM documents WHERE length(text) > 100")
def episode_files(spark, sf):
    episode = F.struct(F.col("doc_id").cast("string").alias("episode_number"), F.col("source").alias("title"), F.col("text").alias("full_transcript"))
    path = json_files(table(spark, sf, "documents").select(F.col("doc_id").alias("k"), episode.alias("o")), folder(spark, "episodes"))
    rows = files.episodes(spark, path)
    return rows.select("episode_number", "title", F.length("full_transcript").cast("long").alias("letters"))


@query("extraction_files", "SELECT 'entity' AS kind, p_name AS name, p_type AS type, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'relationship', p_brand, 'MADE_BY', count(*) FROM part GROUP BY ALL")
def extraction_files(spark, sf):
    entities = F.array(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("type")))
    relationships = F.array(F.struct(F.col("p_name").alias("source"), F.lit("MADE_BY").alias("type"), F.col("p_brand").alias("target")))
    path = json_files(table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.struct(entities.alias("entities"), relationships.alias("relationships")).alias("o")), folder(spark, "extractions"))
    found, links = files.extractions(spark, path, "entities array<struct<name: string, type: string>>, relationships array<struct<source: string, type: string, target: string>>")
    found = found.select(F.lit("entity").alias("kind"), "name", "type").unionByName(links.select(F.lit("relationship").alias("kind"), F.col("target").alias("name"), "type"))
    return found.groupBy("kind", "name", "type").agg(F.count(F.lit(1)).alias("n"))


@query("category_matrix", "SELECT n_nationkey AS episode_id, r_name AS category FROM nation JOIN region ON (n_nationkey + r_regionkey) % 3 = 0")
def category_matrix(spark, sf):
    """The regions as columns from the sixth on, a nation a row, a mark in every third cell."""
    names = F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name")))
    head = table(spark, sf, "region").agg(names.alias("r"))
    rows = table(spark, sf, "nation").crossJoin(F.broadcast(head))
    cells = F.array_join(F.transform("r", lambda x: F.when((F.col("n_nationkey") + x["r_regionkey"]) % 3 == 0, F.lit(" x ")).otherwise(F.lit(""))), ",")
    lines = rows.select(F.concat_ws(",", "n_nationkey", "n_name", F.lit("a"), F.lit("b"), F.lit("c"), cells).alias("line"))
    titles = F.concat(F.lit("banner\nid,guest,x,y,z,"), F.array_join(F.transform("r", lambda x: x["r_name"]), ","))
    whole = lines.agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("body")).crossJoin(head).select(F.concat(titles, F.lit("\n"), "body", F.lit("\nnot a number,a,b,c,d,X\n7,short")).alias("value"))
    path = folder(spark, "matrix")
    whole.coalesce(1).write.text(path)
    return files.categories(spark, path)


@query("taxonomy_file", "SELECT r_name AS pillar, n_name AS category, concat('about ', n_name) AS description FROM nation JOIN region ON r_regionkey = n_regionkey")
def taxonomy_file(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    pillars = nation.join(region, nation.n_regionkey == region.r_regionkey).groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.concat(F.lit("about "), "n_name")))).alias("c"))
    path = folder(spark, "taxonomy")
    pillars.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("r_name", "c"))).alias("pillars"))).alias("value")).coalesce(1).write.text(path)
    return files.taxonomy(spark, path)


@query("book_files", "SELECT concat('book', n_nationkey) AS folder, n_name AS title, concat('author ', n_regionkey) AS author, n_nationkey + 1 AS pages FROM nation")
def book_files(spark, sf):
    path = folder(spark, "books")
    rows = table(spark, sf, "nation").select(F.concat(F.lit("book"), "n_nationkey").alias("folder"), F.to_json(F.struct(F.col("n_name").alias("title"), F.concat(F.lit("author "), "n_regionkey").alias("author"), (F.col("n_nationkey") + 1).alias("pages"))).alias("value"))
    rows.repartition("folder").write.partitionBy("folder").text(path)
    # Spark names its files itself; a book's only file is its metadata.
    return files.books(spark, path, "part-*").select(F.regexp_replace("folder", "^folder=", "").alias("folder"), "title", "author", "pages")


def vectors(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rows.select(F.concat(F.lit("n"), F.col("label") % 3).alias("namespace"), F.col("vec_id").cast("string").alias("id"), "embedding", F.array(F.concat(F.lit("label"), "label"), F.lit("kept")).alias("labels"))


@query("vector_roundtrip", "SELECT concat('n', label % 3) AS namespace, count(*) AS n, CAST(max(len(embedding)) AS INTEGER) AS dimension, count(*) FILTER (WHERE vec_id % 5 = 0) AS replaced FROM embeddings GROUP BY 1")
def vector_roundtrip(spark, sf):
    """Rows into a store, out as JSON lines, into another store, every fifth one replaced there."""
    first, second, lines = (folder(spark, x) for x in ("store", "store", "lines"))
    rows = vectors(spark, sf)
    vector_store.upsert(rows, first)
    vector_store.export(spark, first, lines)
    vector_store.load(spark, lines, second)
    vector_store.upsert(rows.filter(F.col("id").cast("long") % 5 == 0).withColumn("labels", F.array(F.lit("new"))), second)
    found = vector_store.read(spark, second)
    stats = files.index_statistics(found)
    return stats.join(found.groupBy("namespace").agg(F.count_if(F.array_contains("labels", "new")).alias("replaced")), "namespace")


@query("stored_migration", "SELECT concat('n', label % 3) AS namespace, count(*) FILTER (WHERE label IN (1, 4, 5)) AS changed, count(*) FILTER (WHERE label IN (1, 4, 5)) AS migrated, 0::BIGINT AS again FROM embeddings GROUP BY 1")
def stored_migration(spark, sf):
    path, stale = folder(spark, "store"), {"label1": "one", "label4": "kept", "label5": "five"}
    vector_store.upsert(vectors(spark, sf), path)
    changed = vector_store.migrate_labels(spark, path, stale)
    again = vector_store.migrate_labels(spark, path, stale, dry_run=True).withColumnRenamed("changed", "again")
    rows = vector_store.read(spark, path)
    new = rows.groupBy("namespace").agg(F.count_if(F.arrays_overlap("labels", F.array(F.lit("one"), F.lit("five"))) | (F.size("labels") == 1)).alias("migrated"))
    return changed.join(new, "namespace").join(again, "namespace")


TOPICS = ("soil", "the", "and", "carbon", "with", "that", "from", "this")


@query("conversation_topics", "WITH c AS (SELECT conv_id, lower(string_agg(text, ' ' ORDER BY turn)) AS t FROM conversations GROUP BY 1) SELECT conv_id, array_to_string(list_filter([" + ", ".join(f"'{t}'" for t in TOPICS) + "], lambda k: contains(t, k))[1:5], ',') AS topics FROM c")
def conversation_topics(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["text"]), " ").alias("t"))
    return rows.select("conv_id", F.array_join(X.topics(F.col("t"), list(TOPICS)), ",").alias("topics"))


@query("model_batches", "SELECT doc_id, length(text) AS letters, length(text) - length(replace(text, 'e', '')) AS score FROM documents")
def model_batches(spark, sf):
    """A stand-in for a model, given to the rows batch by batch."""

    def score(frame):
        text = frame["text"].fillna("")
        return frame.assign(letters=text.str.len(), score=text.str.count("e"))[["doc_id", "letters", "score"]]

    return chunking.batches_through(table(spark, sf, "documents").select("doc_id", "text"), score, "doc_id long, letters long, score long")


@query("rss_feed", "SELECT concat('Episode ', o_orderkey, ' & more') AS title, concat('https://pods.example/', o_orderkey) AS link, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 7 <> 0")
def rss_feed(spark, sf):
    """Orders as items of a feed, every seventh without a title."""
    title = F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("<title>Episode "), "o_orderkey", F.lit(" &amp; more</title>")))
    item = F.concat(F.lit("<item>"), title, F.lit("<link>https://pods.example/"), "o_orderkey", F.lit("</link><pubDate>"), F.date_format(F.col("o_orderdate").cast("timestamp"), "EEE, d MMM yyyy HH:mm:ss"), F.lit(' +0000</pubDate><enclosure url="x.mp3"/></item>'))
    path = folder(spark, "feed")
    # A feed of at most a thousand items a file.
    feeds = table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).alias("file")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("value"))
    feeds.repartition("file").write.partitionBy("file").text(path)
    return files.rss(spark, f"{path}/*/").select("title", "link", F.date_format("published", "yyyy-MM-dd").alias("day"))


@query("wiki_files", "SELECT 'nations' AS folder, count(*) AS pages FROM nation UNION ALL SELECT 'regions', count(*) FROM region UNION ALL SELECT 'nation links', count(*) FROM nation UNION ALL SELECT 'indexes', 2")
def wiki_files(spark, sf):
    """Pages of nations and regions, written and read as files."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    entities = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("Nation").alias("type"), F.lit("a nation").alias("description"))
    entities = entities.unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("Region").alias("type"), F.lit(None).cast("string").alias("description")))
    edges = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("PART_OF").alias("type"))
    path = folder(spark, "wiki")
    files.write_pages(files.wiki_pages(entities, edges), path)
    rows = spark.read.text(path, wholetext=True)
    index = F.col("file") == "Index.md"
    name = F.when(index, "indexes").otherwise(F.col("folder"))
    counts = rows.groupBy(name.alias("folder")).agg(F.count(F.lit(1)).alias("pages"))
    linked = rows.filter(~index & F.col("value").contains("- PART_OF: [[")).agg(F.lit("nation links").alias("folder"), F.count(F.lit(1)).alias("pages"))
    return counts.unionByName(linked.select("folder", "pages"))
