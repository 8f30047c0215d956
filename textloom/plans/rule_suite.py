"""Queries of rule operators: triples, names, labels, categories, domains and retrieval methods, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import corrections as K
from textloom.operators import ontology as O
from textloom.operators import resolution as R
from textloom.operators import search as S
from textloom.operators import text_index as I
from textloom.operators import triples as T
from textloom.plans.catalogue import query
from textloom.plans.search_suite import BM25, CAT, KW, SEM, TERMS, index, lists
from textloom.sources import files
from textloom.sources.tables import table

# --- triples: rows made from part, with every case that the rules tell apart
TRIPLES = """SELECT p_partkey AS id,
  CASE p_partkey % 6 WHEN 0 THEN 'The Book of Bolts' WHEN 1 THEN 'he' WHEN 2 THEN 'we' WHEN 3 THEN p_name WHEN 4 THEN 'It' ELSE 'John Smith' END AS source,
  CASE p_partkey % 5 WHEN 0 THEN 'wrote' WHEN 1 THEN 'contains' WHEN 2 THEN 'compiled' WHEN 3 THEN 'is a' ELSE 'located in' END AS relationship,
  CASE p_partkey % 8 WHEN 0 THEN 'Mary Jones' WHEN 1 THEN p_name WHEN 2 THEN 'amount of steel' WHEN 3 THEN '1999' WHEN 4 THEN 'the sacred soul of' WHEN 5 THEN 'a "half quote' WHEN 6 THEN 'a bridge' ELSE '95%' END AS target,
  concat('Anna Bell said that John Smith made a ', p_name) AS evidence, p_size / 50.0 AS p_true FROM part"""


def triples(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    df = spark.sql(TRIPLES)
    return df.withColumn("p_true", F.col("p_true").cast("double"))


@query("pp_authorship", f"SELECT id, turn AS reversed, CASE WHEN turn THEN target ELSE source END AS source, CASE WHEN turn THEN source ELSE target END AS target FROM (SELECT *, relationship IN ('wrote', 'compiled') AND starts_with(source, 'The ') AND target = 'Mary Jones' AS turn FROM ({TRIPLES}) t) t")
def pp_authorship(spark, sf):
    return T.authorship(triples(spark, sf)).select("id", "reversed", "source", "target")


@query("pp_titles", f"SELECT id, bad AS incomplete_title, round(CAST(p_true AS DOUBLE) * CASE WHEN bad THEN 0.7 ELSE 1 END, 6) AS p_true FROM (SELECT *, target LIKE '% of' OR length(target) - length(replace(target, chr(34), '')) = 1 AS bad FROM ({TRIPLES}) t) t")
def pp_titles(spark, sf):
    return T.incomplete_title(triples(spark, sf)).select("id", "incomplete_title", F.round("p_true", 6).alias("p_true"))


@query("pp_predicates", f"SELECT id, bad AS invalid_predicate, round(CAST(p_true AS DOUBLE) * CASE WHEN bad THEN 0.3 ELSE 1 END, 6) AS p_true FROM (SELECT *, target = '1999' OR (source = target AND relationship <> 'contains') AS bad FROM ({TRIPLES}) t) t")
def pp_predicates(spark, sf):
    return T.invalid_predicate(triples(spark, sf)).select("id", "invalid_predicate", F.round("p_true", 6).alias("p_true"))


@query("pp_pronouns", f"SELECT id, source = 'It' AS unresolved_pronoun, CASE source WHEN 'he' THEN 'John Smith' WHEN 'we' THEN 'humanity' ELSE source END AS source FROM ({TRIPLES}) t")
def pp_pronouns(spark, sf):
    return T.pronouns(triples(spark, sf).withColumn("window", F.col("evidence"))).select("id", "unresolved_pronoun", "source")


@query("pp_context", f"SELECT id, CASE target WHEN 'amount of steel' THEN 'steel' ELSE target END AS target FROM ({TRIPLES}) t")
def pp_context(spark, sf):
    return T.context(triples(spark, sf)).select("id", "target")


@query("pp_figurative", f"SELECT id, bad AS figurative, round(CAST(p_true AS DOUBLE) * CASE WHEN bad THEN 0.6 ELSE 1 END, 6) AS p_true FROM (SELECT *, contains(target, 'sacred') OR (relationship = 'is a' AND target = 'a bridge') AS bad FROM ({TRIPLES}) t) t")
def pp_figurative(spark, sf):
    return T.figurative(triples(spark, sf)).select("id", "figurative", F.round("p_true", 6).alias("p_true"))


@query("triple_issues", f"""SELECT id, concat_ws(',', CASE WHEN target IN ('1999', '95%') THEN 'number without context' END, CASE WHEN source IN ('It', 'he', 'we') THEN 'generic entity' END, CASE WHEN source = target THEN 'odd' END,
  CASE WHEN len(list_filter(string_split(lower(target), ' '), lambda w: contains(lower(evidence), w))) < 0.7 * len(string_split(target, ' ')) THEN 'not in evidence' END) AS issues FROM ({TRIPLES}) t""")
def triple_issues(spark, sf):
    return T.issues(triples(spark, sf)).select("id", F.array_join("issues", ",").alias("issues"))


@query("triple_quality", f"SELECT id FROM ({TRIPLES}) t WHERE p_size_share >= 0.5 AND NOT figurative".replace("p_size_share", "p_true").replace("NOT figurative", "NOT (contains(target, 'sacred') OR (relationship = 'is a' AND target = 'a bridge')) AND NOT (target LIKE '% of' OR contains(target, chr(34))) AND p_true * 1.0 >= 0.5"))
def triple_quality(spark, sf):
    rows = T.figurative(T.incomplete_title(triples(spark, sf)))
    return T.quality_filter(rows, 0.5, ("figurative", "incomplete_title")).select("id")


# --- names, labels, files
@query("guest_names", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_type ELSE 'Guest' END AS guest FROM part")
def guest_names(spark, sf):
    about = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" is a maker. More is said."))).otherwise(F.lit("Nothing said."))
    subtitle = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("A talk with friends with "), "p_type")).otherwise(F.lit("A talk"))
    return table(spark, sf, "part").select("p_partkey", X.guest_name(about, subtitle).alias("guest"))


@query("guest_topics", "SELECT p_partkey, p_name AS guest, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS topic, CAST(p_partkey AS INTEGER) AS episode FROM part")
def guest_topics(spark, sf):
    title = F.concat(F.lit("Episode "), "p_partkey", F.lit(" - "), "p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" on "), "p_type")).otherwise(F.lit("")))
    rows = table(spark, sf, "part").withColumn("x", X.guest_topic(title)).withColumn("episode", X.episode_number(title))
    return rows.select("p_partkey", "x.guest", "x.topic", "episode")


@query("file_names", "SELECT p_partkey, concat(replace(p_name, ' ', '_'), '_and_', p_type) AS name, concat('<a href=', chr(34), p_type, '.html', chr(34), '>', p_type, '</a>') AS link, concat('&lt;b&gt;', p_type, '&lt;/b&gt; &amp; ', p_name) AS safe FROM part")
def file_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.file_name(F.concat("p_name", F.lit(" & "), "p_type", F.lit("?:*"))).alias("name"), X.wiki_links(F.concat(F.lit("[["), "p_type", F.lit("]]"))).alias("link"), X.html_escape(F.concat(F.lit("<b>"), "p_type", F.lit("</b> & "), "p_name")).alias("safe"))


@query("clean_pages", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[ \\t]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+')), chr(10)) AS text FROM documents")
def clean_pages(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_pdf_text(F.col("text")).alias("text"))


@query("canonical_scores", "SELECT p_type, CAST((CASE WHEN ascii(p_type) BETWEEN 65 AND 90 THEN 10 ELSE 0 END) + (CASE WHEN upper(p_type) <> p_type THEN 5 ELSE 0 END) + 3 + count(*) AS BIGINT) AS score FROM part GROUP BY p_type UNION ALL SELECT p_name, CAST(5 + 3 + count(*) AS BIGINT) FROM part GROUP BY p_name")
def canonical_scores(spark, sf):
    part = table(spark, sf, "part")
    counts = part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).unionByName(part.groupBy(F.col("p_name").alias("p_type")).agg(F.count(F.lit(1)).alias("n")))
    return counts.select("p_type", X.canonical_score(F.col("p_type"), F.col("n")).cast("long").alias("score"))


STALE = {"ECONOMY": "BUDGET", "PROMO": "OFFER", "SMALL": "BUDGET"}


@query("label_migration", "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'BUDGET,' || p_brand WHEN p_type = 'PROMO' THEN 'OFFER,BUDGET,' || p_brand END AS labels FROM (SELECT * FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'PROMO')) t")
def label_migration(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("namespace"), F.array("p_type", F.when(F.col("p_type").isin("ECONOMY", "SMALL", "PROMO"), F.lit("BUDGET")).otherwise(F.lit("KEPT")), "p_brand").alias("labels"))
    return files.migrate(rows, STALE)[0].select("p_partkey", F.array_join("labels", ",").alias("labels"))


@query("label_migration_report", "SELECT p_brand AS namespace, count(*) AS changed FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'PROMO') GROUP BY 1")
def label_migration_report(spark, sf):
    return files.migrate(table(spark, sf, "part").select(F.col("p_brand").alias("namespace"), F.array("p_type").alias("labels")), STALE)[1]


@query("index_statistics", "SELECT CAST(label AS VARCHAR) AS namespace, count(*) AS n, CAST(max(len(embedding)) AS INTEGER) AS dimension FROM embeddings GROUP BY 1")
def index_statistics(spark, sf):
    return files.index_statistics(table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("namespace"), "embedding"))


@query("ndjson_rows", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 = 0 AND json_extract(props, '$.k') IS NOT NULL")
def ndjson_rows(spark, sf):
    # One line in three is whole; the others are broken or blank.
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"event_id": '), "event_id", F.lit(", "), F.expr("substr(props, 2)"))).when(F.col("event_id") % 3 == 1, F.lit("{broken")).otherwise(F.lit("  "))
    return files.ndjson(table(spark, sf, "events").select(line.alias("value")), "event_id long, k long, _bad string").filter("_bad IS NULL").select("event_id", "k")


@query("properties", "SELECT p_brand, bool_or(p_type = 'ECONOMY') AS financial, bool_or(p_type = 'PROMO') AS knowledge_transfer, bool_or(p_type = 'LARGE') AS creative, bool_or(p_type = 'SMALL') AS causal, bool_or(p_type = 'MEDIUM') AS attributive FROM part GROUP BY 1")
def properties(spark, sf):
    names = {"ECONOMY": "REFINANCES", "PROMO": "MENTORS", "LARGE": "PRODUCES", "SMALL": "LEADS_TO", "MEDIUM": "HAS_PART", "STANDARD": "MEETS"}
    kinds = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set(kinds[F.col("p_type")]).alias("m")).select("p_brand", X.properties(F.col("m")).alias("x")).select("p_brand", "x.*")


@query("pair_signals", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(0.2 * jaro_winkler_similarity(a.n_name, b.n_name) + 0.1 * 1 + 0.3 * CASE WHEN a.n_regionkey = b.n_regionkey THEN 1 ELSE 0 END + 0.4 * 0.5, 6) AS score FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def pair_signals(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("an"), F.col("n_regionkey").alias("ar")), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("bn"), F.col("n_regionkey").alias("br"))
    rows = a.join(F.broadcast(b), F.col("a") < F.col("b"))  # 25 nations at any scale
    same = X.jaccard(F.array("ar"), F.array("br"))
    return rows.select("a", "b", F.round(X.match_score(X.jaro_winkler("an", "bn"), F.lit(1.0), same, F.lit(0.5)), 6).alias("score"))


@query("admin_parents", "SELECT n_nationkey, n_regionkey < 3 OR n_regionkey = 4 AS parent FROM nation")
def admin_parents(spark, sf):
    child = F.array(F.lit("world"), F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("n"), "n_nationkey"))
    parent = F.when(F.col("n_regionkey") == 4, F.array().cast("array<string>")).when(F.col("n_regionkey") < 3, F.array(F.lit("world"), F.concat(F.lit("r"), "n_regionkey"))).otherwise(F.array(F.lit("world"), F.lit("rx")))
    return table(spark, sf, "nation").select("n_nationkey", R.is_parent(parent, child).alias("parent"))


# --- categories, relations, domains
CATS = {"TION": ("edre", "hean"), "THAT WITH": ("onon",), "SOIL": ("so il",), "ANDHA": ()}
ROWS = " UNION ALL ".join(
    f"SELECT conv_id, turn, '{n}' AS category, (CASE WHEN contains(regexp_replace(lower(text), '[ \\t\\n\\r_-]', '', 'g'), '{n.lower().replace(' ', '')}') THEN 1.0 ELSE 0.0 END)"
    + "".join(f" + (CASE WHEN contains(lower(text), '{w}') THEN {s} ELSE 0.0 END)" for w, s in [*[(x, 0.8) for x in syn], *[(x, 0.5) for x in n.lower().split() if len(x) > 3]])
    + " AS score FROM conversations"
    for n, syn in CATS.items()
)


@query("category_scores", f"SELECT conv_id, turn, category, round(CAST(score AS DOUBLE), 6) AS score FROM ({ROWS}) t WHERE score > 0")
def category_scores(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.explode(O.category_scores(F.col("text"), CATS)).alias("category", "score")).withColumn("score", F.round("score", 6))


@query("episode_scores", "SELECT doc_id, round(CAST(sum(s) AS DOUBLE) / 2.8, 6) AS score FROM (SELECT DISTINCT doc_id, CASE lang WHEN 'en' THEN 1.5 WHEN 'de' THEN 1.3 ELSE 0 END AS s FROM documents) t GROUP BY doc_id HAVING sum(s) > 0 ORDER BY 2 DESC, 1 LIMIT 20")
def episode_scores(spark, sf):
    members = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", "TION").when(F.col("lang") == "de", "THAT WITH").otherwise("SOIL").alias("category"))
    # TION: its name and the longer word of its name; THAT WITH: one synonym and one word.
    return O.episode_scores(members, "A station, onon, within", CATS, 20).withColumn("score", F.round("score", 6))


@query("special_rules", "WITH q AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations), m AS (SELECT query_id, 'SOIL' AS category, 0.5 AS score FROM q WHERE query_id % 2 = 0) SELECT query_id, category, CAST(score AS DOUBLE) AS score FROM m UNION ALL SELECT query_id, 'SOIL', 0.72 FROM q WHERE query_id % 2 <> 0 AND (contains(lower(text), 'edre') OR contains(lower(text), 'onon')) UNION ALL SELECT query_id, 'HERBAL', 0.78 FROM q WHERE contains(lower(text), 'hean')")
def special_rules(spark, sf):
    q = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    even = F.col("query_id") % 2 == 0
    rows = q.withColumn("category", F.when(even, F.lit("SOIL"))).withColumn("score", F.when(even, F.lit(0.5)))
    return O.special_rules(rows, F.col("text"), {"SOIL": (0.72, ("edre", "onon")), "HERBAL": (0.78, ("hean",))})


@query("normalized_relations", "SELECT p_partkey, p_type AS raw, CASE p_type WHEN 'ECONOMY' THEN 'SAVES' WHEN 'PROMO' THEN 'OFFERS' ELSE 'ASSOCIATES' END AS canonical, CASE p_type WHEN 'ECONOMY' THEN 'AFFECTS' WHEN 'PROMO' THEN 'GIVES' ELSE 'ASSOCIATES' END AS abstract, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence FROM part")
def normalized_relations(spark, sf):
    known = {"ECONOMY": ("SAVES", "AFFECTS"), "PROMO": ("OFFERS", "GIVES")}
    return table(spark, sf, "part").select("p_partkey", O.normalized_relation(F.col("p_type"), known).alias("x")).select("p_partkey", "x.*")


@query("domain_types", "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'OFFER' WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'VALUE' WHEN p_type = 'LARGE' THEN 'SIZE' ELSE 'RELATES' END AS domain, CASE WHEN p_type IN ('STANDARD', 'MEDIUM') THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM part")
def domain_types(spark, sf):
    # LARGE_PART holds no pattern; its part LARGE begins the pattern LARGENESS.
    rows = table(spark, sf, "part").select("p_partkey", O.domain_type(F.concat("p_type", F.lit("_PART")), [("PROMO", "OFFER"), ("ECON", "VALUE"), ("SMALL", "VALUE"), ("LARGENESS", "SIZE")]).alias("x"))
    return rows.select("p_partkey", "x.*")


@query("domains", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN h >= greatest(1, 0.5 * greatest(h, m)) THEN 'Heat' END, CASE WHEN m >= greatest(1, 0.5 * greatest(h, m)) THEN 'Machines' END, CASE WHEN h + m = 0 THEN 'Ecology' END], lambda x: x IS NOT NULL), ',') AS domains FROM (SELECT p_partkey, CAST(contains(p_name, 'hot') AS INT) + CAST(contains(p_name, 'cold') AS INT) AS h, CAST(contains(p_name, 'gear') AS INT) + CAST(contains(p_name, 'bolt') AS INT) + CAST(contains(lower(p_type), 'o') AS INT) AS m FROM part) t")
def domains(spark, sf):
    words = {"Heat": ("hot", "cold"), "Machines": ("gear", "bolt", "|o")}
    text = F.concat("p_name", F.when(F.contains("p_type", F.lit("O")), F.lit("|o")).otherwise(F.lit("")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(O.domains(text, words), ",").alias("domains"))


@query("resolved_aliases", "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'Economy goods' WHEN p_type = 'PROMO' THEN 'Promotion' ELSE p_type END AS resolved FROM part")
def resolved_aliases(spark, sf):
    aliases = spark.createDataFrame([(" eco-nomy", "Economy goods"), ("Promo.", "Promotion")], "alias string, name string")
    return O.alias_resolve(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", aliases).select("p_partkey", "resolved")


@query("merged_extractions", "SELECT key, name, description, seq, n FROM (SELECT lower(p_type) AS key, p_type AS name, p_name AS description, p_partkey AS seq, count(*) OVER (PARTITION BY lower(p_type)) AS n, row_number() OVER (PARTITION BY lower(p_type) ORDER BY length(p_name) DESC, p_partkey) AS k FROM part) t WHERE k = 1")
def merged_extractions(spark, sf):
    return O.merged_extractions(table(spark, sf, "part").select(F.col("p_type").alias("name"), F.col("p_name").alias("description"), F.col("p_partkey").alias("seq")))


@query("frequent_terms", r"SELECT cluster, word, n FROM (SELECT lang AS cluster, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS k FROM (SELECT lang, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: length(x) > 2)) AS word FROM documents) t GROUP BY lang, word) t WHERE k <= 10")
def frequent_terms(spark, sf):
    return O.frequent_terms(table(spark, sf, "documents").select(F.col("lang").alias("cluster"), F.explode(S.tokens(F.col("text"))).alias("word")))


@query("token_counts", r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) AS INTEGER) AS tokens FROM documents")
def token_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", O.token_count(F.col("text")).alias("tokens"))


@query("category_fallback", "WITH c AS (SELECT p_partkey AS label, p_name AS name, string_split(p_name || ' ' || lower(p_type), ' ') AS t FROM part), s AS (SELECT label, len(list_intersect(list_distinct(t), ['red', 'bolt', 'economy'])) / (CAST(len(list_distinct(t)) AS DOUBLE) + 3 - len(list_intersect(list_distinct(t), ['red', 'bolt', 'economy']))) + CASE WHEN name IN ('red', 'bolt', 'economy') THEN 0.3 ELSE 0 END AS score FROM c) SELECT label, round(score, 6) AS score FROM s WHERE score >= 0.2 ORDER BY s.score DESC, label LIMIT 15")
def category_fallback(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("label"), F.col("p_name").alias("name"), F.concat("p_name", F.lit(" "), "p_type").alias("description"))
    return S.jaccard_match(["red", "bolt", "economy"], rows, 0.2, 15).withColumn("score", F.round("score", 6))


# --- aggregates that keep lists
@query("entity_unions", "SELECT key, type, array_to_string(list_sort(list_distinct(list(p_size))), ',') AS episodes, arg_max(p_name, length(p_name) * 1000000000 - p_partkey) AS description, count(*) AS mention_count, count(DISTINCT p_size) AS episode_count FROM (SELECT lower(p_type) AS key, p_brand AS type, p_size, p_name, p_partkey FROM part) t GROUP BY key, type")
def entity_unions(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_type").alias("name"), F.col("p_brand").alias("type"), F.col("p_size").alias("episode"), F.col("p_name").alias("description"), F.col("p_partkey").alias("seq"))
    return R.merge_entities(rows).withColumn("episodes", F.array_join(F.col("episodes").cast("array<string>"), ","))


@query("variant_sets", "SELECT lower(p_type) AS key, array_to_string(list_sort(list_distinct(list(v))), ',') AS variants, count(*) AS n FROM (SELECT p_type, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE lower(p_type) END AS v FROM part) t GROUP BY 1")
def variant_sets(spark, sf):
    v = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.lower("p_type"))
    return table(spark, sf, "part").groupBy(F.lower("p_type").alias("key")).agg(F.array_join(F.array_sort(F.collect_set(v)), ",").alias("variants"), F.count(F.lit(1)).alias("n"))


@query("first_titles", "SELECT source, lang, count(*) AS n, arg_min(substr(text, 1, 40), doc_id) AS title FROM documents GROUP BY 1, 2")
def first_titles(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.substring("text", 1, 40), "doc_id").alias("title"))


@query("stratified_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, (SELECT count(DISTINCT source) FROM documents) AS g FROM documents) t WHERE k <= 100 // g")
def stratified_sample(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id")
    groups = docs.agg(F.count_distinct("source").alias("g"))
    rows = S.ranked(docs, F.asc("doc_id"), partition=["source"]).crossJoin(F.broadcast(groups))  # one row
    return rows.filter(F.col("rank") < F.floor(F.lit(100) / F.col("g"))).select("source", "doc_id")


@query("viz_counts", "SELECT 'type' AS kind, p_type AS name, count(*) AS n FROM part GROUP BY p_type UNION ALL SELECT 'domain', d, count(*) FROM (SELECT unnest(CASE WHEN p_size > 25 THEN [p_brand, 'big'] ELSE [p_brand] END) AS d FROM part) t GROUP BY d")
def viz_counts(spark, sf):
    part = table(spark, sf, "part")
    own = F.when(F.col("p_size") > 25, F.array("p_brand", F.lit("big"))).otherwise(F.array("p_brand"))
    count = lambda df, kind: df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
    return count(part.select(F.col("p_type").alias("name")), "type").unionByName(count(part.select(F.explode(own).alias("name")), "domain"))


@query("cache_keys", "SELECT p_partkey, sha1(concat(sha1(concat(p_name, '|', p_brand)), '|', 'v1', '|', substr(sha1(p_type), 1, 8))) AS cache_key FROM part")
def cache_keys(spark, sf):
    uid = F.sha1(F.concat_ws("|", "p_name", "p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.sha1(F.concat_ws("|", uid, F.lit("v1"), F.substring(F.sha1("p_type"), 1, 8))).alias("cache_key"))


@query("category_ids", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label LIMIT 2) SELECT array_to_string(list_sort(list(vec_id)), ',') AS ids, count(*) AS n FROM embeddings WHERE label IN (SELECT label FROM c)")
def category_ids(spark, sf):
    rows = table(spark, sf, "embeddings")
    best = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(2)
    found = rows.join(F.broadcast(best.select("label")), "label", "left_semi")
    return found.agg(F.array_join(F.array_sort(F.collect_set("vec_id")).cast("array<string>"), ",").alias("ids"), F.count(F.lit(1)).alias("n"))


@query("positive_scores", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm WHERE round(score, 6) > 0")
def positive_scores(spark, sf):
    found = I.scores(index(spark, sf), TERMS)
    return found.select("doc_id", F.round("score", 6).alias("score")).filter("score > 0")


# --- retrieval methods
FUSED = f"{BM25}, {KW}, {SEM}, {CAT}, fused AS (SELECT doc_id, round(sum(s), 8) AS score, bool_or(c) AS is_category FROM (SELECT doc_id, 0.15 / (61 + rank) AS s, false AS c FROM kw UNION ALL SELECT doc_id, 0.25 / (61 + rank), false FROM sem UNION ALL SELECT doc_id, 0.6 / (61 + rank), true FROM cat) GROUP BY doc_id)"


@query("hybrid_search", f"WITH {FUSED} SELECT doc_id, score FROM fused ORDER BY is_category DESC, score DESC, doc_id LIMIT 10")
def hybrid_search(spark, sf):
    return S.retrieve("hybrid", *lists(spark, sf), k=10)


@query("reranked_search", f"WITH {FUSED}, first AS (SELECT * FROM fused ORDER BY is_category DESC, score DESC, doc_id LIMIT 20) SELECT f.doc_id, f.score FROM first f JOIN documents d ON f.doc_id = d.doc_id ORDER BY d.n_chars DESC, f.score DESC, f.doc_id LIMIT 10")
def reranked_search(spark, sf):
    return S.retrieve("hybrid", *lists(spark, sf), k=10, scores=table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("model_score")))


@query("bm25_method", f"WITH {BM25}, {KW} SELECT doc_id, score FROM kw ORDER BY score DESC, doc_id LIMIT 10")
def bm25_method(spark, sf):
    return S.retrieve("bm25", *lists(spark, sf), k=10)


@query("recommendations", f"WITH {BM25}, best AS (SELECT doc_id, source, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 6) SELECT doc_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k FROM best) t WHERE k = 1 ORDER BY score DESC, doc_id LIMIT 3")
def recommendations(spark, sf):
    docs = table(spark, sf, "documents")
    found = I.search(index(spark, sf), TERMS, 6).select("doc_id", F.round("score", 6).alias("score"))
    return S.recommendations(found.join(docs.select("doc_id", "source"), "doc_id"))


# --- corrections: relationships and corrections made from part, with every case that the rules tell apart
LINKS = "SELECT p_partkey AS seq, CASE p_partkey % 5 WHEN 0 THEN 'located_in' WHEN 1 THEN 'part_of' WHEN 2 THEN 'contains' WHEN 3 THEN 'makes' ELSE 'grows' END AS relationship, CASE p_partkey % 7 WHEN 0 THEN 'an unknown place' WHEN 1 THEN 'Biochar' WHEN 2 THEN 'Lebanese' WHEN 3 THEN p_name WHEN 4 THEN 'Unclear Hill' WHEN 5 THEN 'a Concept or principle' ELSE 'an African' END AS target, CASE p_partkey % 3 WHEN 0 THEN 'her grandmother' WHEN 1 THEN p_brand ELSE 'person' END AS source, CAST(0.5 + p_size / 100.0 AS DOUBLE) AS confidence FROM part"
MARKS = f"SELECT l.*, CASE seq % 4 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'RETYPE' WHEN 2 THEN 'DELETE' ELSE 'REVERSE' END AS action, CASE WHEN seq % 4 = 1 THEN 'is' END AS corrected, CASE WHEN seq % 8 < 4 THEN 'Abstract idea' ELSE 'wrong' END AS reasoning FROM ({LINKS}) l WHERE seq % 3 = 0"
VAGUE2 = "(contains(lower(target), 'unknown') OR contains(lower(target), 'unclear'))"
VAGUE3 = f"({VAGUE2} OR contains(lower(target), 'unspecified'))"
LESSONS = f"lessons AS (SELECT seq, 0 AS place, 'vague_entity_deletion' AS type, NULL AS term FROM marks WHERE action = 'DELETE' AND {VAGUE2} UNION ALL SELECT seq, o, 'abstract_as_location', t FROM marks, (SELECT 1 AS o, 'biochar' AS t UNION ALL SELECT 2, 'concept' UNION ALL SELECT 3, 'principle') WHERE action = 'DELETE' AND contains(lower(reasoning), 'abstract') AND contains(lower(target), t) UNION ALL SELECT seq, 4, 'wrong_relation_type_nationality', NULL FROM marks WHERE action = 'RETYPE' AND contains(relationship, 'part_of') AND contains(corrected, 'is') UNION ALL SELECT seq, 5, 'reversed_geographic', NULL FROM marks WHERE action = 'REVERSE')"
PATTERNS = "patterns AS (SELECT type, min(seq * 10 + place) AS first, count(*) AS n, arg_min(term, seq * 10 + place) FILTER (WHERE term IS NOT NULL) AS term FROM lessons GROUP BY type)"


def links(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    return spark.sql(LINKS), spark.sql(MARKS)


GEO_RULE = " OR ".join(f"contains(lower(relationship), '{g}')" for g in ("located_in", "part_of", "contains", "in", "based_in"))


@query("suspicious_patterns", f"WITH links AS ({LINKS}) SELECT seq, 'vague_location' AS pattern FROM links WHERE ({GEO_RULE}) AND {VAGUE3} UNION ALL SELECT seq, 'abstract_as_location' FROM links WHERE ({GEO_RULE}) AND (contains(lower(target), 'biochar') OR contains(lower(target), 'sustainability') OR contains(lower(target), 'concept') OR contains(lower(target), 'principle')) UNION ALL SELECT seq, 'wrong_relationship_type' FROM links WHERE contains(relationship, 'part_of') AND (contains(source, 'mother') OR contains(source, 'father') OR contains(source, 'person')) AND (contains(lower(target), 'lebanese') OR contains(lower(target), 'american') OR contains(lower(target), 'european'))")
def suspicious_patterns(spark, sf):
    return K.suspicious(links(spark, sf)[0]).select("seq", "pattern")


@query("low_confidence", f"SELECT CASE WHEN confidence < 0.60 THEN 'below' WHEN confidence < 0.65 THEN '0.60-0.65' WHEN confidence < 0.70 THEN '0.65-0.70' ELSE '0.70-0.75' END AS range, count(*) AS n FROM ({LINKS}) WHERE confidence < 0.75 GROUP BY 1")
def low_confidence(spark, sf):
    return K.confidence_ranges(links(spark, sf)[0])


@query("learned_patterns", f"WITH marks AS ({MARKS}), {LESSONS}, {PATTERNS} SELECT type, n, term FROM patterns")
def learned_patterns(spark, sf):
    return K.learn(links(spark, sf)[1]).select("type", "n", "term")


@query("learned_corrections", f"WITH links AS ({LINKS}), marks AS ({MARKS}), {LESSONS}, {PATTERNS}, hits AS (SELECT seq, type, n, first FROM links, patterns WHERE (type = 'vague_entity_deletion' AND {VAGUE3}) OR (type = 'abstract_as_location' AND contains(lower(target), term) AND (contains(relationship, 'located_in') OR contains(relationship, 'part_of') OR contains(relationship, 'contains'))) OR (type = 'wrong_relation_type_nationality' AND contains(relationship, 'part_of') AND (contains(lower(target), 'lebanese') OR contains(lower(target), 'american') OR contains(lower(target), 'european') OR contains(lower(target), 'african')))), best AS (SELECT seq, arg_min(type, first) AS pattern, arg_min(n, first) AS n FROM hits GROUP BY seq) SELECT l.seq, CASE WHEN pattern = 'wrong_relation_type_nationality' THEN 'RETYPE' WHEN pattern IS NOT NULL THEN 'DELETE' WHEN confidence < 0.70 THEN 'REVIEW' END AS action, CASE WHEN pattern = 'wrong_relation_type_nationality' THEN 'is' END AS corrected, pattern, n / 10 AS pattern_confidence FROM links l LEFT JOIN best USING (seq)")
def learned_corrections(spark, sf):
    rels, marks = links(spark, sf)
    return K.apply(rels, K.learn(marks)).select("seq", "action", "corrected", "pattern", "pattern_confidence")


@query("correction_summary", f"WITH marks AS ({MARKS}), {LESSONS} SELECT 'action' AS kind, action AS name, count(*) AS n FROM marks GROUP BY action UNION ALL SELECT * FROM (SELECT 'pattern', type, count(*) AS n FROM lessons GROUP BY type ORDER BY n DESC, type LIMIT 10)")
def correction_summary(spark, sf):
    return K.report(links(spark, sf)[1])


NAMED = "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN concat(p_name, ' City') WHEN 1 THEN concat('State of ', p_brand) WHEN 2 THEN concat(p_brand, ' Foundation') WHEN 3 THEN 'Zinc works' WHEN 4 THEN 'First Bank of Colorado' WHEN 5 THEN 'Anna Maria Bell' WHEN 6 THEN 'anna bell' WHEN 7 THEN '' ELSE p_name END AS name FROM part"
PLACES_RULE = " OR ".join(f"contains(lower(name), '{w}')" for w in ("city", "county", "state", "country", "region"))
ORGS_RULE = " OR ".join(f"contains(lower(name), '{w}')" for w in ("inc", "llc", "corp", "foundation", "institute", "university"))
BOOK_ORGS = " OR ".join(f"contains(lower(name), '{w}')" for w in ("bank", "company", "corporation", "foundation", "institute", "organization"))
BOOK_PLACES = " OR ".join(f"contains(lower(name), '{w}')" for w in ("colorado", "usa", "america", "city", "county", "state"))


@query("entity_types", f"SELECT p_partkey, CASE WHEN {PLACES_RULE} THEN 'Place' WHEN {ORGS_RULE} THEN 'Org' ELSE 'UNKNOWN' END AS kind, CASE WHEN trim(name) = '' THEN 'UNKNOWN' WHEN {BOOK_ORGS} THEN 'Org' WHEN {BOOK_PLACES} THEN 'Place' WHEN regexp_matches(name, '^[A-Z]') AND contains(name, ' ') AND len(list_filter(string_split(name, ' '), lambda w: w <> '')) <= 3 THEN 'Person' ELSE 'UNKNOWN' END AS book_kind FROM ({NAMED})")
def entity_types(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    return spark.sql(NAMED).select("p_partkey", K.entity_type(F.col("name")).alias("kind"), K.entity_type(F.col("name"), books=True).alias("book_kind"))


#: Claims of documents: some without a hash, some hashed before their document changed, some repeated.
CLAIMED = "SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN NULL WHEN doc_id % 9 = 0 THEN {sha}(concat(text, ' ')) ELSE {sha}(text) END AS doc_sha256, sha1(CAST(doc_id - CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END AS STRING)) AS claim_uid, CAST(0.6 + (n_chars % 40) / 100.0 AS DOUBLE) AS p_true FROM documents"


@query("acceptance_tests", "WITH r AS (" + CLAIMED.replace("{sha}", "sha256") + "), j AS (SELECT r.*, sha256(d.text) AS now FROM r JOIN documents d USING (doc_id)) SELECT 'AT-01' AS test, round(100.0 * count(doc_sha256) / count(*), 4) AS value, CAST(count(*) FILTER (WHERE doc_sha256 <> now) AS DOUBLE) AS detail, round(100.0 * count(doc_sha256) / count(*), 4) >= 95 AS passed FROM j UNION ALL SELECT 'AT-02', CAST(count(claim_uid) - count(DISTINCT claim_uid) AS DOUBLE), CAST(count(claim_uid) AS DOUBLE), count(claim_uid) = count(DISTINCT claim_uid) FROM j UNION ALL SELECT 'AT-05', round(avg(p_true), 6), round(100.0 * count(*) FILTER (WHERE p_true >= 0.75) / count(p_true), 4), avg(p_true) BETWEEN 0.5 AND 0.95 AND 100.0 * count(*) FILTER (WHERE p_true >= 0.75) / count(p_true) >= 70 FROM j")
def acceptance_tests(spark, sf):
    docs = table(spark, sf, "documents")
    docs.createOrReplaceTempView("documents")
    return K.acceptance(spark.sql(CLAIMED.replace("{sha}(concat(text, ' '))", "sha2(concat(text, ' '), 256)").replace("{sha}(text)", "sha2(text, 256)")), docs)
