"""File sources and sinks: episodes, books, categories, extractions, vector exports, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPISODE = "episode_number string, title string, subtitle string, description string, publish_date string, audio_url string, url string, full_transcript string, about_sections map<string,string>, related_episodes array<struct<title:string,url:string>>, segments array<struct<id:int,start:double,end:double,text:string,speaker:string>>, _corrupt_record string"


def episodes(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """SRC1, SRC2: episode files by name; broken files and transcripts of 100 letters and less are left out."""
    rows = spark.read.schema(EPISODE).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    if limit:
        rows = rows.orderBy("file").limit(limit)
    return rows.filter(F.col("_corrupt_record").isNull() & (F.length("full_transcript") > 100)).drop("_corrupt_record")


def categories(spark: SparkSession, path: str, first: int = 6) -> DataFrame:
    """SRC5: (episode_id, category) of a wide CSV whose second row is its header and whose cells hold X."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).filter("n > 0")
    cells = lines.select("n", F.split("line", ",").alias("c"))
    head = cells.filter("n = 1").select(F.posexplode("c").alias("i", "category"))
    body = cells.filter((F.col("n") > 1) & (F.size("c") >= 5)).select(F.expr("try_cast(trim(c[0]) AS int)").alias("episode_id"), F.posexplode("c").alias("i", "mark"))
    return body.join(F.broadcast(head), "i").filter((F.col("i") >= first - 1) & F.col("episode_id").isNotNull() & (F.upper(F.trim("mark")) == "X")).select("episode_id", F.trim("category").alias("category")).distinct()


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: (pillar, category, description); a missing file, broken JSON or a missing key is an error."""
    schema = T.StructType([T.StructField("pillars", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    first = rows.first()
    if first is None or first["pillars"] is None:
        raise ValueError("the taxonomy has no pillars")
    return rows.select(F.explode("pillars").alias("pillar", "c")).select("pillar", F.explode("c").alias("category", "description"))


def extractions(spark: SparkSession, path: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC7: entities and relationships of extraction files; without a schema all files are read for it first."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    return rows.select("file", F.explode("entities").alias("e")).select("file", "e.*"), rows.select("file", F.explode("relationships").alias("r")).select("file", "r.*")


def export_jsonl(df: DataFrame, path: str) -> int:
    """SRC8: writes JSON lines and compares the counts."""
    n = df.count()
    df.write.mode("overwrite").json(path)
    if df.sparkSession.read.schema(df.schema).json(path).count() != n:
        raise ValueError("the export is not whole")
    return n


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SRC9, SRC10: rows of new take the place of rows of old with their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def ndjson(lines: DataFrame, schema: str) -> DataFrame:
    """SC51: parsed lines; blank and broken ones are left out."""
    rows = lines.filter(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.select("r.*").na.drop("all")


def page_fields(pages: DataFrame) -> DataFrame:
    """SRC14: title, number of links and visible length of each page."""
    html = F.col("html")
    plain = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style).*?</(script|style)>", " "), "<[^>]*>", " ")
    return pages.select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.length(F.trim(F.regexp_replace(plain, r"\s+", " "))).cast("long").alias("visible"))


def guarded_write(df: DataFrame, path: str, locked: bool) -> None:
    """SRC22: refuses to write while a migration runs."""
    if locked:
        raise RuntimeError("a migration is in progress")
    df.write.mode("overwrite").parquet(path)


def index_statistics(vectors: DataFrame) -> DataFrame:
    """SRC23."""
    return vectors.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dimension"))


def migrate(rows: DataFrame, stale: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """SRC24: the rows whose labels change, rewritten, and how many of each namespace do."""
    from textloom.functions.text import rewrite_labels

    new = rows.withColumn("new", rewrite_labels(F.col("labels"), stale)).filter(~F.col("new").eqNullSafe(F.col("labels")))
    return new.withColumn("labels", F.col("new")).drop("new"), new.groupBy("namespace").agg(F.count(F.lit(1)).alias("changed"))


def books(spark: SparkSession, path: str, file: str = "metadata.json") -> DataFrame:
    """SRC3: book metadata, one JSON file a folder, with the folder's name; broken files are left out."""
    rows = spark.read.schema("title string, author string, pages int, _corrupt_record string").option("multiLine", True).json(f"{path}/*/{file}")
    return rows.withColumn("folder", F.element_at(F.split(F.input_file_name(), "/"), -2)).filter("_corrupt_record IS NULL").drop("_corrupt_record")


def feed_items(feed: DataFrame, known: DataFrame) -> DataFrame:
    """SRC13: rows of a feed (title) whose title names an episode that `known` (episode) lacks, with its number."""
    items = feed.withColumn("episode", F.expr(r"try_cast(nullif(regexp_extract(title, 'Episode\\s+([0-9]+)', 1), '') AS BIGINT)"))
    return items.filter(F.col("episode").isNotNull()).join(known.select("episode").distinct(), "episode", "left_anti")


def preview(chunks: DataFrame, most: int = 10, letters: int = 200) -> DataFrame:
    """SRC19: the first chunks (id, text) by id, shortened, with the number, letters and mean length of all chunks."""
    total = chunks.agg(F.count(F.lit(1)).alias("total"), F.sum(F.length("text")).alias("letters"), F.round(F.avg(F.length("text")), 4).alias("mean_length"))
    first = chunks.orderBy("id").limit(most).select("id", F.substring("text", 1, letters).alias("preview"))
    return first.crossJoin(F.broadcast(total))


def rss(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: the items of RSS feeds in XML files: title, link, published (null if it can't be read), audio; broken items are left out."""
    schema = "title string, link string, pubDate string, enclosure struct<_url: string>, _corrupt_record string"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path).filter("_corrupt_record IS NULL AND title IS NOT NULL")
    published = F.try_to_timestamp(F.regexp_replace("pubDate", r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return rows.select("title", "link", published.alias("published"), F.col("enclosure._url").alias("audio"))


def wiki_pages(entities: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """SRC18: (folder, file, body): a Markdown page for each entity (id, name, type, description) with its first `most` links by
    relation and name of edges (src, dst, type), and an index page for each type."""
    from textloom.functions.text import file_name

    named = entities.select(F.col("id").alias("dst"), F.col("name").alias("other"))
    linked = edges.join(named, "dst").select(F.col("src").alias("id"), "type", "other").distinct()
    first = linked.withColumn("k", F.expr("row_number() OVER (PARTITION BY id ORDER BY type, other)")).filter(F.col("k") <= most)
    lines = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("type", "other"))).alias("l"))
    folder = F.concat(F.lower("type"), F.lit("s"))
    links = F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["type"], F.lit(": [["), x["other"], F.lit("]]"))), "\n")
    body = F.concat(F.lit("# "), "name", F.lit("\n\n"), F.coalesce("description", F.lit("")), F.when(F.col("l").isNotNull(), F.concat(F.lit("\n\n## Links\n\n"), links)).otherwise(F.lit("")), F.lit("\n"))
    pages = entities.join(lines, "id", "left").select(folder.alias("folder"), F.concat(file_name(F.col("name")), F.lit(".md")).alias("file"), body.alias("body"))
    # An index names no more than a thousand pages; the folder has them all.
    ranked = entities.withColumn("k", F.expr("row_number() OVER (PARTITION BY type ORDER BY name, id)")).withColumn("n", F.expr("count(*) OVER (PARTITION BY type)")).filter("k <= 1000")
    index = ranked.groupBy("type", "n").agg(F.array_sort(F.collect_list("name")).alias("names"))
    listed = F.array_join(F.transform("names", lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n")
    return pages.unionByName(index.select(folder.alias("folder"), F.lit("Index.md").alias("file"), F.concat(F.lit("# "), "type", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n\n"), listed, F.lit("\n")).alias("body")))


def write_pages(pages: DataFrame, path: str) -> None:
    """Writes each page (folder, file, body) as the text of `path`/folder=.../file=...; pages of one name stand together."""
    pages.select("folder", "file", F.col("body").alias("value")).repartition("folder", "file").write.partitionBy("folder", "file").text(path)
