"""Categories of queries, names of relations, domains: rule tables given by the caller, applied as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import any_of, normalize_key


def squashed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[\s_-]", "")


def category_scores(text: Column, categories: dict[str, tuple[str, ...]]) -> Column:
    """SC6: map of the categories (with their synonyms) that score: 1 for the name, 0.8 a synonym, 0.5 a longer word of the name."""
    low = F.lower(text)
    scores = []
    for name, synonyms in categories.items():
        score = F.when(F.contains(squashed(text), squashed(F.lit(name))), 1.0).otherwise(0.0)
        for part, worth in [*[(x, 0.8) for x in synonyms], *[(x, 0.5) for x in name.lower().split() if len(x) > 3]]:
            score = score + F.when(F.contains(low, F.lit(part.lower())), worth).otherwise(0.0)
        scores.append(F.struct(F.lit(name).alias("key"), score.alias("value")))
    return F.map_from_entries(F.filter(F.array(*scores), lambda x: x["value"] > 0))


def episode_scores(members: DataFrame, text: str, categories: dict[str, tuple[str, ...]], most: int = 20) -> DataFrame:
    """SC7, RK22: (doc_id, score) of the documents whose categories (doc_id, category) hold the largest share of the query's scores."""
    scores = category_scores(F.lit(text), categories)
    total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, x: a + x)
    share = F.sum(F.coalesce(F.try_element_at(scores, F.col("category")), F.lit(0.0))) / F.any_value(total)
    rows = members.select("doc_id", "category").distinct().groupBy("doc_id").agg(share.alias("score"))
    return rows.filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(most)


def special_rules(matches: DataFrame, text: Column, rules: dict[str, tuple[float, tuple[str, ...]]]) -> DataFrame:
    """SC11: rows (query_id, category, score) and those that rules add (category: score, words of the text) where the
    category is absent; with the query's text on every row of matches or of a query without matches (category null)."""
    found = F.array(*[F.when(any_of(F.lower(text), words), F.struct(F.lit(c).alias("category"), F.lit(s).alias("score"))) for c, (s, words) in rules.items()])
    more = matches.select("query_id", F.explode(F.array_compact(found)).alias("x")).select("query_id", "x.*").distinct()
    own = matches.filter(F.col("category").isNotNull()).select("query_id", "category", "score")
    return own.unionByName(more.join(own, ["query_id", "category"], "left_anti"))


def normalized_relation(raw: Column, variants: dict[str, tuple[str, str]], other: tuple[str, str] = ("ASSOCIATES", "ASSOCIATES")) -> Column:
    """SC30: raw, canonical and abstract name, and 1.0 for a known variant, else 0.7."""
    names = F.create_map(*[x for k, (c, a) in variants.items() for x in (F.lit(k), F.struct(F.lit(c).alias("canonical"), F.lit(a).alias("abstract")))])
    hit = F.try_element_at(names, F.upper(F.trim(raw)))
    return F.struct(raw.alias("raw"), F.coalesce(hit["canonical"], F.lit(other[0])).alias("canonical"), F.coalesce(hit["abstract"], F.lit(other[1])).alias("abstract"), F.when(hit.isNotNull(), 1.0).otherwise(0.7).alias("confidence"))


def domain_type(raw: Column, patterns: list[tuple[str, str]], nearest: Column | None = None, similarity: Column | None = None, other: str = "RELATES") -> Column:
    """SC31: the domain of the first pattern in the name; else of the first pattern that begins with a part of it; else the
    nearest one by embedding from 0.7 on; else `other`. Confidence 1.0, or 0.5 for the last."""
    up = F.upper(raw)
    inside = F.coalesce(*[F.when(F.contains(up, F.lit(p)), F.lit(d)) for p, d in patterns])
    parts = F.filter(F.split(up, "_"), lambda x: F.length(x) > 2)

    def begun(pattern):
        return F.exists(parts, lambda x: F.startswith(F.lit(pattern), x))

    begins = F.coalesce(*[F.when(begun(p), F.lit(d)) for p, d in patterns])
    near = F.lit(None).cast("string") if nearest is None else F.when(similarity >= 0.7, nearest)
    found = F.coalesce(inside, begins, near)
    return F.struct(F.coalesce(found, F.lit(other)).alias("domain"), F.when(found.isNotNull(), 1.0).otherwise(0.5).alias("confidence"))


def domains(text: Column, words: dict[str, tuple[str, ...]], other: str = "Ecology") -> Column:
    """SC41: domains whose number of words found is at least 1 and half of the most; else one default."""
    low = F.lower(text)
    hits = F.array(*[F.struct(F.lit(k).alias("domain"), sum((F.contains(low, F.lit(w)).cast("int") for w in v), F.lit(0)).alias("n")) for k, v in words.items()])
    most = F.array_max(F.transform(hits, lambda x: x["n"]))
    kept = F.transform(F.filter(hits, lambda x: x["n"] >= F.greatest(F.lit(1.0), 0.5 * most)), lambda x: x["domain"])
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(other)))


def alias_resolve(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """SC19: adds `resolved`: the name that aliases (alias, name) gives for the key of the column, else the column."""
    key = aliases.select(normalize_key(F.col("alias")).alias("_key"), F.col("name").alias("_name")).dropDuplicates(["_key"])
    return rows.withColumn("_key", normalize_key(F.col(column))).join(key, "_key", "left").withColumn("resolved", F.coalesce("_name", column)).drop("_key", "_name")


def merged_extractions(entities: DataFrame) -> DataFrame:
    """AG22: of each lower name the entity with the longest description; the first (seq) of equal ones."""
    return entities.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.max_by(F.struct("name", "description", "seq"), F.struct(F.length("description"), -F.col("seq"))).alias("x"), F.count(F.lit(1)).alias("n")).select("key", "x.*", "n")


def frequent_terms(words: DataFrame, most: int = 10) -> DataFrame:
    """RK21: of rows (cluster, word) the most frequent words of each cluster, ties by word."""
    from textloom.operators.search import ranked

    counts = words.groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("n"))
    return ranked(counts, F.desc("n"), F.asc("word"), partition=["cluster"]).filter(F.col("rank") < most).drop("rank")


def token_count(text: Column) -> Column:
    """SC40: whitespace words, a stand-in for a tokenizer's count."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
