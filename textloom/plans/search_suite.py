"""Retrieval queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import search as S
from textloom.operators import text_index as I
from textloom.plans.catalogue import query
from textloom.sources.tables import table

TERMS = ["the", "and", "with", "this"]
TOK = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: length(x) > 2)"
POST = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY ALL"
BM25 = f"""
rows AS (SELECT doc_id, source, {TOK} AS toks FROM documents),
sz AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM rows),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM rows) GROUP BY term),
idf AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM df, sz),
w AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END AS w FROM idf WHERE term IN ('the', 'and', 'with', 'this')),
hit AS (SELECT doc_id, source, len(toks) AS dl, t.term, count(*) AS tf FROM (SELECT doc_id, source, toks, unnest(toks) AS term FROM rows) t GROUP BY ALL),
bm AS (SELECT doc_id, source, sum(w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM hit JOIN w USING (term), sz GROUP BY doc_id, source HAVING score > 0)
"""
COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 7) AS DOUBLE[]))"


def q7(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id = 7").select(F.col("embedding").alias("q"))


def index(spark, sf):
    """The stored index of the documents; the first query of a session builds it."""
    return I.index_of(table(spark, sf, "documents"))


def score(df, name="score", digits=6):
    return df.withColumn(name, F.round(name, digits) + 0.0)


@query("bm25_topk", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id DESC LIMIT 20")
def bm25_topk(spark, sf):
    return S.top(score(I.search(index(spark, sf), TERMS, 20)), 20, F.desc("score"), F.desc("doc_id"))


@query("term_frequencies", f"WITH p AS ({POST}) SELECT doc_id, CAST(sum(tf) AS BIGINT) AS total_words, count(*) AS unique_words FROM p GROUP BY doc_id")
def term_frequencies(spark, sf):
    return S.doc_stats(S.postings(table(spark, sf, "documents")))


@query("index_stats", f"WITH p AS ({POST}), s AS (SELECT doc_id, sum(tf) AS n, count(*) AS u FROM p GROUP BY doc_id) SELECT count(*) AS documents, CAST((SELECT count(DISTINCT term) FROM p) AS BIGINT) AS terms, round(avg(n), 4) AS avg_words, round(avg(u), 4) AS avg_unique FROM s")
def index_stats(spark, sf):
    p = S.postings(table(spark, sf, "documents"))
    s = S.doc_stats(p).agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("total_words"), 4).alias("avg_words"), F.round(F.avg("unique_words"), 4).alias("avg_unique"))
    return s.crossJoin(p.agg(F.count_distinct("term").alias("terms")))


@query("tf_keyword_topk", f"WITH p AS ({POST}), s AS (SELECT doc_id, sum(tf) AS n FROM p GROUP BY doc_id) SELECT doc_id, round(sum(tf / n), 6) AS score, count(*) AS matched FROM p JOIN s USING (doc_id) WHERE term IN ('the', 'and', 'with', 'this') GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 15")
def tf_keyword_topk(spark, sf):
    return S.top(score(I.tf_scores(index(spark, sf), TERMS)), 15, F.desc("score"), F.asc("doc_id"))


@query("doc_top_terms", f"WITH p AS ({POST}) SELECT doc_id, term, tf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS r FROM p) WHERE r <= 5")
def doc_top_terms(spark, sf):
    p = S.postings(table(spark, sf, "documents"))
    return S.ranked(p, F.desc("tf"), F.asc("term"), partition=["doc_id"]).filter("rank < 5").drop("rank")


@query("vector_topk", f"SELECT vec_id, label, round({COS}, 4) + 0.0 AS score FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 10")
def vector_topk(spark, sf):
    return score(S.vector_search(table(spark, sf, "embeddings"), q7(spark, sf), 10), digits=4)


@query("vector_topk_filtered", f"SELECT vec_id, label, round({COS}, 4) + 0.0 AS score FROM embeddings WHERE label IN (1, 3) ORDER BY {COS} DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark, sf):
    return score(S.vector_search(table(spark, sf, "embeddings"), q7(spark, sf), 10, F.col("label").isin(1, 3)), digits=4)


KW = f"kw AS (SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) - 1 AS rank FROM bm ORDER BY rank LIMIT 20)"
SEM = f"sem AS (SELECT vec_id AS doc_id, round({COS}, 4) + 0.0 AS score, row_number() OVER (ORDER BY round({COS}, 4) DESC, vec_id) - 1 AS rank FROM embeddings ORDER BY rank LIMIT 20)"
CAT = "cat AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 20)"


def lists(spark, sf):
    kw = score(I.search(index(spark, sf), TERMS, 20))
    kw = S.ranked(S.top(kw, 20, F.desc("score"), F.asc("doc_id")), F.desc("score"), F.asc("doc_id"))
    sem = table(spark, sf, "embeddings").crossJoin(F.broadcast(q7(spark, sf))).select(F.col("vec_id").alias("doc_id"), (F.round(S.cosine(F.col("embedding"), F.col("q")), 4) + 0.0).alias("score"))
    sem = S.ranked(S.top(sem, 20, F.desc("score"), F.asc("doc_id")), F.desc("score"), F.asc("doc_id"))
    cat = table(spark, sf, "embeddings").filter("label = 3").select(F.col("vec_id").alias("doc_id")).orderBy("doc_id").limit(20)
    return kw, sem, S.ranked(cat, F.asc("doc_id"))


@query("rrf_fusion", f"WITH {BM25}, {KW}, {SEM} SELECT doc_id, round(sum(1.0 / (60 + rank + 1)), 8) AS score FROM (SELECT doc_id, rank FROM kw UNION ALL SELECT doc_id, rank FROM sem) GROUP BY doc_id")
def rrf_fusion(spark, sf):
    kw, sem, _ = lists(spark, sf)
    return score(S.rrf([kw, sem]), digits=8)


@query("weighted_fusion", f"WITH {BM25}, {KW}, {SEM} SELECT doc_id, round(0.4 * coalesce(kw.score + (20.0 - kw.rank) / 20, 0) + 0.6 * coalesce(sem.score, 0), 6) AS score FROM kw FULL JOIN sem USING (doc_id)")
def weighted_fusion(spark, sf):
    kw, sem, _ = lists(spark, sf)
    return score(S.weighted_fusion(kw, sem))


@query("category_first_fusion", f"WITH {BM25}, {KW}, {SEM}, {CAT} SELECT doc_id, round(sum(s), 8) AS score, bool_or(c) AS is_category FROM (SELECT doc_id, 0.15 / (61 + rank) AS s, false AS c FROM kw UNION ALL SELECT doc_id, 0.25 / (61 + rank), false FROM sem UNION ALL SELECT doc_id, 0.6 / (61 + rank), true FROM cat) GROUP BY doc_id")
def category_first_fusion(spark, sf):
    return score(S.category_first(*lists(spark, sf)), digits=8)


@query("diverse_search", f"WITH {BM25}, g AS (SELECT count(DISTINCT source) AS g FROM bm), r AS (SELECT doc_id, source, round(score, 6) AS score, row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, doc_id) - 1 AS rank FROM bm) SELECT doc_id, source, score FROM r, g WHERE rank < least(greatest(3, 30 // g), greatest(3, 30 // greatest(g // 2, 1))) ORDER BY score DESC, doc_id LIMIT 30")
def diverse_search(spark, sf):
    docs = table(spark, sf, "documents")
    return S.diverse(score(I.scores(index(spark, sf), TERMS)).join(docs.select("doc_id", "source"), "doc_id"), 30)


@query("dedup_citations", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1 ORDER BY n_chars DESC, doc_id LIMIT 3")
def dedup_citations(spark, sf):
    return S.keep_first(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], F.desc("n_chars"), F.asc("doc_id"), most=3)


@query("method_comparison", f"WITH {BM25}, {KW}, {SEM} SELECT * FROM (SELECT 'keyword' AS method, doc_id, CAST(rank AS INTEGER) AS rank FROM kw WHERE rank < 3 UNION ALL SELECT 'semantic', doc_id, CAST(rank AS INTEGER) FROM sem WHERE rank < 3)")
def method_comparison(spark, sf):
    kw, sem, _ = lists(spark, sf)
    return kw.filter("rank < 3").select(F.lit("keyword").alias("method"), "doc_id", "rank").unionByName(sem.filter("rank < 3").select(F.lit("semantic").alias("method"), "doc_id", "rank"))


@query("chain_comparison", f"WITH {BM25}, {KW}, {SEM} SELECT (SELECT count(*) FROM kw WHERE doc_id NOT IN (SELECT doc_id FROM sem)) AS unique_left, (SELECT count(*) FROM sem WHERE doc_id NOT IN (SELECT doc_id FROM kw)) AS unique_right, (SELECT count(*) FROM kw WHERE doc_id IN (SELECT doc_id FROM sem)) AS common")
def chain_comparison(spark, sf):
    kw, sem, _ = lists(spark, sf)
    a, b = kw.select("doc_id"), sem.select("doc_id")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(a.subtract(b), "unique_left").crossJoin(n(b.subtract(a), "unique_right")).crossJoin(n(a.intersect(b), "common"))


@query("category_match", "WITH c AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i), k AS (SELECT label, list(v ORDER BY i) AS centroid FROM c GROUP BY label), s AS (SELECT label, least(list_cosine_similarity(centroid, CAST((SELECT embedding FROM embeddings WHERE vec_id = 7) AS DOUBLE[])) + CASE WHEN contains('about label 3', 'label ' || label) THEN 0.2 ELSE 0 END, 1.0) AS score FROM k) SELECT label, round(score, 4) + 0.0 AS score FROM s WHERE score >= 0.05 ORDER BY s.score DESC, label LIMIT 5")
def category_match(spark, sf):
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    cat = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centroid")).withColumn("name", F.concat(F.lit("label "), "label"))
    return score(S.category_match(q7(spark, sf).withColumn("text", F.lit("About label 3")), cat, 0.05, 5), digits=4)


METHOD = "CASE WHEN regexp_matches(t, 'episode\\s*\\d+') OR contains(t, 'carbon sequestration') OR contains(t, 'soil') THEN 'keyword_heavy' WHEN w > 15 THEN 'semantic_heavy' ELSE 'hybrid' END"
ANALYSED = f"SELECT doc_id, {METHOD} AS method FROM (SELECT doc_id, lower(text) AS t, len(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents)"


@query("adaptive_weights", f"SELECT doc_id, CASE method WHEN 'keyword_heavy' THEN 0.25 WHEN 'semantic_heavy' THEN 0.1 ELSE 0.15 END::DOUBLE AS keyword, CASE method WHEN 'keyword_heavy' THEN 0.15 WHEN 'semantic_heavy' THEN 0.3 ELSE 0.25 END::DOUBLE AS semantic FROM ({ANALYSED})")
def adaptive_weights(spark, sf):
    w = S.adaptive_weights(S.analyze_query(F.col("text"), ["carbon sequestration", "soil"]))
    return table(spark, sf, "documents").select("doc_id", w["keyword"].alias("keyword"), w["semantic"].alias("semantic"))


#: A query text of each method: text, whether it matched a category, and the method's weights.
TEXTS = {
    "keyword_heavy": ("what is in episode 12", True, (0.25, 0.15, 0.6)),
    "semantic_heavy": ("tell me " + "very " * 14 + "much", True, (0.1, 0.3, 0.6)),
    "category_heavy": ("herbs and food", True, (0.05, 0.15, 0.8)),
    "hybrid": ("herbs and food", False, (0.15, 0.25, 0.6)),
}


def fused_sql(method):
    k, s, c = TEXTS[method][2]
    parts = f"SELECT doc_id, {k} / (61 + rank) AS s, false AS c FROM kw UNION ALL SELECT doc_id, {s} / (61 + rank), false FROM sem UNION ALL SELECT doc_id, {c} / (61 + rank), true FROM cat"
    return f"(SELECT '{method}' AS method, doc_id, round(sum(s), 8) AS score FROM ({parts}) GROUP BY doc_id ORDER BY bool_or(c) DESC, score DESC, doc_id LIMIT 5)"


@query("dispatched_search", f"WITH {BM25}, {KW}, {SEM}, {CAT} " + " UNION ALL ".join(f"SELECT * FROM {fused_sql(m)}" for m in TEXTS))
def dispatched_search(spark, sf):
    found = lists(spark, sf)
    out = None
    for method, (text, matched, _) in TEXTS.items():
        part = S.retrieve("auto", *found, k=5, text=text, technical=["carbon sequestration"], matched=matched).select(F.lit(method).alias("method"), "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out
