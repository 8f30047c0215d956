"""Retrieval: keyword index, TF and BM25 scores, vector search, fusion and diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]{3,}"
#: BM25 defaults: term saturation, length weight, floor factor of negative idf.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rank constant of reciprocal rank fusion.
RRF_K = 60


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits that are longer than two characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf): one row per document and term."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("doc_id").agg(F.sum("tf").alias("total_words"), F.count(F.lit(1)).alias("unique_words"))


def bm25(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """(doc_id, score > 0). Only the query's terms leave the scan; a repeated query term counts again.

    idf = ln((N - df + .5) / (df + .5)); a negative one becomes epsilon times the mean idf of all terms.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("toks"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("toks")).alias("avgdl"))
    # The mean idf needs the document frequency of every term.
    df = rows.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(size.select("n"))).select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf").alias("mean"))
    wanted = [(t, terms.count(t)) for t in dict.fromkeys(terms)]
    query = docs.sparkSession.createDataFrame(wanted, "term string, times int")
    weights = idf.join(F.broadcast(query), "term").crossJoin(mean).select("term", (F.col("times") * F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf"))).alias("w"))
    hits = rows.select("doc_id", F.size("toks").alias("dl"), F.explode(F.filter("toks", lambda x: x.isin(list(dict.fromkeys(terms))))).alias("term"))
    hits = hits.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    hits = hits.join(F.broadcast(weights), "term").crossJoin(F.broadcast(size.select("avgdl")))
    score = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("doc_id").agg(F.sum(score).alias("score")).filter("score > 0")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def ranked(df: DataFrame, *order: Column, partition: list[str] | None = None) -> DataFrame:
    """df with a 0-based rank; df is a bounded result list unless it is partitioned."""
    w = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    return df.withColumn("rank", F.row_number().over(w.orderBy(*order)) - 1)


def tf_search(index: DataFrame, terms: list[str], min_frequency: int = 1) -> DataFrame:
    """(doc_id, score, matched): sum of tf / total words over the query's terms, repeated terms counting again."""
    query = index.sparkSession.createDataFrame([(t, terms.count(t)) for t in dict.fromkeys(terms)], "term string, times int")
    hits = index.join(F.broadcast(query), "term").filter(F.col("tf") >= min_frequency).join(doc_stats(index), "doc_id")
    return hits.groupBy("doc_id").agg(F.sum(F.col("times") * F.col("tf") / F.col("total_words")).alias("score"), F.count(F.lit(1)).alias("matched"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot / both)


def vector_search(vectors: DataFrame, query: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """Exact nearest vectors of one query vector (a single row `q`), optionally among filtered rows."""
    rows = vectors if where is None else vectors.filter(where)
    return top(rows.crossJoin(F.broadcast(query.limit(1))).select("vec_id", "label", cosine(F.col("embedding"), F.col("q")).alias("score")), k, F.desc("score"), F.asc("vec_id"))


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(doc_id, score): sum of 1 / (k + rank + 1) over result lists with doc_id and rank."""
    union = lists[0].select("doc_id", "rank")
    for x in lists[1:]:
        union = union.unionByName(x.select("doc_id", "rank"))
    return union.groupBy("doc_id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank") + 1)).alias("score"))


def weighted_fusion(keyword: DataFrame, semantic: DataFrame, keyword_weight: float = 0.4, semantic_weight: float = 0.6) -> DataFrame:
    """Full outer merge of two score lists; a keyword score also gains (n - rank) / n; the best chunk score counts."""
    size = keyword.agg(F.count(F.lit(1)).alias("_n"))
    kw = keyword.crossJoin(F.broadcast(size)).select("doc_id", (F.col("score") + (F.col("_n") - F.col("rank")) / F.col("_n")).alias("k"))
    sem = semantic.groupBy("doc_id").agg(F.max("score").alias("s"))
    both = kw.join(sem, "doc_id", "full")
    return both.select("doc_id", (keyword_weight * F.coalesce("k", F.lit(0.0)) + semantic_weight * F.coalesce("s", F.lit(0.0))).alias("score"))


def category_first(keyword: DataFrame, semantic: DataFrame, category: DataFrame, weights: tuple[float, float, float] | Column = (0.15, 0.25, 0.6), k: int = RRF_K) -> DataFrame:
    """Documents of the category list first, then the others, each tier by weighted reciprocal ranks; weights are three
    numbers or a struct of them (keyword, semantic, category)."""
    if not isinstance(weights, Column):
        weights = F.struct(*[F.lit(w).alias(n) for n, w in zip(("keyword", "semantic", "category"), weights, strict=True)])
    union = None
    for name, x in (("keyword", keyword), ("semantic", semantic), ("category", category)):
        part = x.select("doc_id", (weights[name] / (k + F.col("rank") + 1)).alias("s"), F.lit(name == "category").alias("c"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("doc_id").agg(F.sum("s").alias("score"), F.max("c").alias("is_category"))


def diverse(scored: DataFrame, k: int) -> DataFrame:
    """Top rows by score with a cap for each source: max(3, k // groups) gathered, max(3, k // max(groups // 2, 1)) given."""
    groups = F.broadcast(scored.agg(F.count_distinct("source").alias("_g")))
    cap = F.least(F.greatest(F.lit(3), F.floor(F.lit(k) / F.greatest(F.col("_g"), F.lit(1)))), F.greatest(F.lit(3), F.floor(F.lit(k) / F.greatest(F.floor(F.col("_g") / 2), F.lit(1)))))
    order = [F.desc("score"), F.asc("doc_id")]
    # No source gives more than k rows, whatever the number of sources; ranks are cut before they meet the cap.
    rows = ranked(scored, *order, partition=["source"]).filter(F.col("rank") < max(3, k)).crossJoin(groups).filter(F.col("rank") < cap).drop("rank", "_g")
    return top(rows, k, *order)


def keep_first(rows: DataFrame, keys: list[str], *order: Column, most: int | None = None) -> DataFrame:
    """The first row of each key; the first `most` of them."""
    out = ranked(rows, *order, partition=keys).filter("rank = 0").drop("rank")
    return out.orderBy(*order).limit(most) if most else out


def adaptive_weights(method: Column) -> Column:
    """(keyword, semantic, category) weights of a query method."""
    def triple(a, b, c):
        return F.struct(F.lit(a).alias("keyword"), F.lit(b).alias("semantic"), F.lit(c).alias("category"))

    return F.when(method == "keyword_heavy", triple(0.25, 0.15, 0.6)).when(method == "semantic_heavy", triple(0.1, 0.3, 0.6)).when(method == "category_heavy", triple(0.05, 0.15, 0.8)).otherwise(triple(0.15, 0.25, 0.6))


def category_match(query: DataFrame, categories: DataFrame, threshold: float, most: int) -> DataFrame:
    """Categories (label, centroid, name) by cosine with the query (q, text); a name in the text adds 0.2, up to 1."""
    rows = F.broadcast(query.limit(1)).crossJoin(categories)
    score = cosine(F.col("centroid"), F.col("q")) + F.when(F.contains(F.lower("text"), F.lower("name")), 0.2).otherwise(0.0)
    return top(rows.select("label", F.least(score, F.lit(1.0)).alias("score")).filter(F.col("score") >= threshold), most, F.desc("score"), F.asc("label"))


def jaccard_match(query_terms: list[str], categories: DataFrame, threshold: float, most: int) -> DataFrame:
    """Fallback match: Jaccard of term sets, 0.3 more if the name is among the query's terms."""
    q = F.array(*[F.lit(t) for t in dict.fromkeys(query_terms)])
    terms = F.array_distinct(tokens(F.col("description")))
    score = F.size(F.array_intersect(terms, q)) / F.size(F.array_union(terms, q)) + F.when(F.array_contains(q, F.lower("name")), 0.3).otherwise(0.0)
    return top(categories.select("label", score.alias("score")).filter(F.col("score") >= threshold), most, F.desc("score"), F.asc("label"))


def analyze_query(text: Column, technical: list[str], has_category: Column | None = None) -> Column:
    """SC5: the method of a query: an episode number or a technical term asks for keywords, more than 15 words for meaning,
    a matched category for categories; else hybrid."""
    t = F.lower(text)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    named = F.exists(F.array(*[F.lit(x) for x in technical]), lambda x: F.contains(t, x)) if technical else F.lit(False)
    category = F.lit(False) if has_category is None else has_category
    return F.when(t.rlike(r"episode\s*\d+") | named, "keyword_heavy").when(words > 15, "semantic_heavy").when(category, "category_heavy").otherwise("hybrid")


def rerank(found: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """RK12: the 2k rows before the cut in the order of a model's scores (doc_id, model_score); rows without one last."""
    rows = found.join(scores, "doc_id", "left")
    return top(rows, k, F.desc_nulls_last("model_score"), F.desc("score"), F.asc("doc_id"))


METHODS = ("auto", "bm25", "semantic", "hybrid", "keyword_heavy", "semantic_heavy", "category_heavy")


def retrieve(method: str, keyword: DataFrame, semantic: DataFrame, category: DataFrame, k: int = 10, scores: DataFrame | None = None, text: str = "", technical: list[str] = (), matched: bool = False) -> DataFrame:
    """RK11, RK13: (doc_id, score) by "bm25", "semantic" or a hybrid method (ranked lists fused by the weights of the method,
    category first, reranked if there are scores and over k rows). "auto" takes the method that the query's text suggests;
    `matched` says whether it matched a category."""
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    if method in ("bm25", "semantic"):
        return top({"bm25": keyword, "semantic": semantic}[method].select("doc_id", "score"), k, F.desc("score"), F.asc("doc_id"))
    chosen = analyze_query(F.lit(text), list(technical), F.lit(matched)) if method == "auto" else F.lit(method)
    order = [F.desc("is_category"), F.desc("score"), F.asc("doc_id")]
    fused = category_first(keyword, semantic, category, adaptive_weights(chosen)).withColumn("score", F.round("score", 8))
    if scores is None:
        return top(fused, k, *order).select("doc_id", "score")
    return rerank(top(fused, 2 * k, *order), scores, k).select("doc_id", "score")


def recommendations(found: DataFrame, k: int = 3) -> DataFrame:
    """RK17: of the best 2k rows (source, doc_id, score) the first of each source, k at most."""
    order = [F.desc("score"), F.asc("doc_id")]
    return keep_first(top(found, 2 * k, *order), ["source"], *order, most=k)


def graph_first(graph: DataFrame, text: DataFrame, k: int = 8) -> DataFrame:
    """RK16: of rows (chunk_id, preview, score) those of the graph, then those of the text search, each by score and id;
    of equal (chunk_id, preview) the first; the first k, with their origin."""
    rows = graph.withColumn("origin", F.lit("graph")).unionByName(text.withColumn("origin", F.lit("text")))
    return keep_first(rows, ["chunk_id", "preview"], F.asc("origin"), F.desc("score"), F.asc("chunk_id"), most=k)
