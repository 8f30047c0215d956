"""Queries of domains by embeddings, topics, feeds and previews, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import domains as D
from textloom.operators import search as S
from textloom.operators.graph import stored
from textloom.plans.catalogue import query
from textloom.sources import files
from textloom.sources.tables import table

REACH = "reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)"
#: Names, each with the counts of its letters as its vector.
NAMES = "SELECT n_name AS name FROM nation UNION SELECT c_mktsegment FROM customer UNION SELECT o_orderpriority FROM orders UNION SELECT event_type FROM events UNION SELECT r_name FROM region"
VECTORS = f"vectors AS (SELECT name AS id, list_transform(range(97, 123), lambda c: CAST(length(name) - length(replace(lower(name), chr(CAST(c AS INTEGER)), '')) AS DOUBLE)) AS v FROM ({NAMES}))"


def near(least: float) -> str:
    return f"near AS (SELECT a.id AS x, b.id AS y FROM vectors a, vectors b WHERE list_cosine_similarity(a.v, b.v) >= {least} OR a.id = b.id)"


def names(spark, sf):
    for t in ("nation", "customer", "orders", "events", "region"):
        table(spark, sf, t).createOrReplaceTempView(t)
    counts = F.transform(F.sequence(F.lit(97), F.lit(122)), lambda c: (F.length("name") - F.length(F.replace(F.lower("name"), F.char(c), F.lit("")))).cast("double"))
    # The distinct names are stored, or filters on the vectors would move below them and count the letters of every row.
    return stored(spark.sql(NAMES)).select(F.col("name").alias("id"), counts.alias("vector"))


@query("relation_clusters", f"WITH RECURSIVE {VECTORS}, {near(0.7)}, cores AS (SELECT x FROM near GROUP BY x HAVING count(*) >= 3), link AS (SELECT * FROM near WHERE x IN (SELECT x FROM cores) AND y IN (SELECT x FROM cores)), {REACH}, named AS (SELECT x, min(y) AS cluster FROM reach GROUP BY x) SELECT near.x AS id, CASE WHEN near.x IN (SELECT x FROM cores) THEN (SELECT cluster FROM named WHERE named.x = near.x) ELSE min(named.cluster) END AS cluster, near.x IN (SELECT x FROM cores) AS core FROM near JOIN named ON near.y = named.x GROUP BY near.x")
def relation_clusters(spark, sf):
    return D.density_clusters(names(spark, sf))


@query("domain_cohesion", "SELECT n.label AS domain, n.n, round(p.c, 6) AS cohesion FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) n LEFT JOIN (SELECT a.label, avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label) p ON n.label = p.label")
def domain_cohesion(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("domain"), F.col("embedding").alias("vector"))
    return D.cohesion(rows).withColumn("cohesion", F.round("cohesion", 6))


@query("domain_mergers", f"WITH RECURSIVE {VECTORS}, {near(0.85)}, link AS (SELECT * FROM near), {REACH} SELECT x AS id, min(y) AS keep FROM reach GROUP BY x")
def domain_mergers(spark, sf):
    return D.mergers(names(spark, sf))


MEANS = "SELECT label, k, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY label, k"


@query("domain_centroids", f"SELECT label AS id, CAST(count(*) AS INTEGER) AS dimensions, round(sum(m * k), 6) AS mark FROM ({MEANS}) GROUP BY label")
def domain_centroids(spark, sf):
    rows = D.centroids(table(spark, sf, "embeddings").select(F.col("label").alias("domain"), F.col("embedding").alias("vector")))
    mark = F.aggregate(F.zip_with("vector", F.sequence(F.lit(1), F.size("vector")), lambda m, k: m * k), F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", F.size("vector").alias("dimensions"), F.round(mark, 6).alias("mark"))


@query("topic_terms", "WITH w AS (SELECT source AS topic, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents), c AS (SELECT topic, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL), s AS (SELECT topic, sum(n) AS size FROM c GROUP BY topic), f AS (SELECT word, sum(n) AS f FROM c GROUP BY word), x AS (SELECT topic, word, round(n / size * ln(1 + (SELECT sum(n) / count(DISTINCT topic) FROM c) / f), 6) AS weight FROM c JOIN s USING (topic) JOIN f USING (word)) SELECT topic, word, weight FROM x QUALIFY row_number() OVER (PARTITION BY topic ORDER BY weight DESC, word) <= 10")
def topic_terms(spark, sf):
    words = table(spark, sf, "documents").select(F.col("source").alias("topic"), F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return D.topic_terms(words.filter("word <> ''"))


@query("graph_first_answers", "WITH g AS (SELECT doc_id, text, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 6), t AS (SELECT doc_id, text, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 6), u AS (SELECT *, 'graph' AS origin FROM g UNION ALL SELECT *, 'text' FROM t), f AS (SELECT doc_id AS chunk_id, substr(text, 1, 200) AS preview, n_chars AS score, origin FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY origin) = 1) SELECT * FROM f ORDER BY origin, score DESC, chunk_id LIMIT 8")
def graph_first_answers(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.substring("text", 1, 200).alias("preview"), F.col("n_chars").alias("score"), "lang")
    best = [F.desc("score"), F.asc("chunk_id")]
    return S.graph_first(rows.filter("lang = 'en'").orderBy(*best).limit(6).drop("lang"), rows.orderBy(*best).limit(6).drop("lang"))


FEED = "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'Trailer ' || o_orderkey WHEN 1 THEN 'Episode ' || o_orderkey || ': ' || o_orderpriority ELSE 'Bonus, Episode  ' || o_orderkey END AS title FROM orders"


@query("feed_new_episodes", f"SELECT title, CAST(regexp_extract(title, '([0-9]+)', 1) AS BIGINT) AS episode FROM ({FEED}) WHERE contains(title, 'Episode') AND CAST(regexp_extract(title, '([0-9]+)', 1) AS BIGINT) NOT IN (SELECT c_custkey FROM customer)")
def feed_new_episodes(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return files.feed_items(spark.sql(FEED), table(spark, sf, "customer").select(F.col("c_custkey").alias("episode"))).select("title", "episode")


@query("chunk_preview", "SELECT doc_id AS id, substr(text, 1, 200) AS preview, total, letters, mean_length FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 10), (SELECT count(*) AS total, CAST(sum(length(text)) AS BIGINT) AS letters, round(avg(length(text)), 4) AS mean_length FROM documents)")
def chunk_preview(spark, sf):
    return files.preview(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
