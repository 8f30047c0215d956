"""Suspicious relationships, patterns learnt from corrections, and their application to new relationships.

Rows are relationships (source, relationship, target, confidence, other columns). Corrections are rows (seq, action, source,
relationship, target, corrected, reasoning, confidence), in the order of seq. Patterns are few, four at most, and travel as
one row; a null name contains nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import any_of

# Parts of names and relations that the rules look for.
GEO = ("located_in", "part_of", "contains", "in", "based_in")
GEO_STRICT = ("located_in", "part_of", "contains")
VAGUE = ("unknown", "unclear", "unspecified")
ABSTRACT = ("biochar", "sustainability", "concept", "principle")
ABSTRACT_LEARNT = ("biochar", "concept", "principle")
KIN = ("grandmother", "mother", "father", "person")
PEOPLES = ("lebanese", "american", "european")
PEOPLES_LEARNT = ("lebanese", "american", "european", "african")
PLACE_WORDS = ("city", "county", "state", "country", "region")
ORG_WORDS = ("inc", "llc", "corp", "foundation", "institute", "university")
ORG_WORDS_BOOKS = ("bank", "company", "corporation", "foundation", "institute", "organization")
PLACE_WORDS_BOOKS = ("colorado", "usa", "america", "city", "county", "state")
#: Confidence under which a relationship that no pattern corrects goes to review, and examples that a pattern shows.
REVIEW, EXAMPLES = 0.70, 5


def has(column: str, words) -> Column:
    return F.coalesce(any_of(F.lower(column), words), F.lit(False))


def entity_type(name: Column, books: bool = False) -> Column:
    """SC28: Place or Org by parts of the name, else UNKNOWN; the rule for books asks for Org first and takes capitalised names of
    two or three words for a Person."""
    low = F.lower(name)
    if not books:
        return F.when(any_of(low, PLACE_WORDS), "Place").when(any_of(low, ORG_WORDS), "Org").otherwise("UNKNOWN")
    words = F.size(F.filter(F.split(name, r"\s+"), lambda w: w != ""))
    person = name.rlike(r"^\p{Lu}") & F.contains(name, F.lit(" ")) & (words <= 3)
    return F.when(F.trim(name) == "", "UNKNOWN").when(any_of(low, ORG_WORDS_BOOKS), "Org").when(any_of(low, PLACE_WORDS_BOOKS), "Place").when(person, "Person").otherwise("UNKNOWN")


def suspicious(rels: DataFrame) -> DataFrame:
    """FLT16: a row for each suspicious pattern of a relationship, with the column `pattern`."""
    geo = has("relationship", GEO)
    kin = has("relationship", ["part_of"]) & has("source", KIN) & has("target", PEOPLES)
    found = F.array(F.when(geo & has("target", VAGUE), "vague_location"), F.when(geo & has("target", ABSTRACT), "abstract_as_location"), F.when(kin, "wrong_relationship_type"))
    return rels.withColumn("pattern", F.explode(F.array_compact(found)))


def confidence_ranges(rels: DataFrame) -> DataFrame:
    """FLT16: (range, n) of the relationships with a confidence below 0.75."""
    c = F.col("confidence")
    name = F.when(c < 0.60, "below").when(c < 0.65, "0.60-0.65").when(c < 0.70, "0.65-0.70").otherwise("0.70-0.75")
    return rels.filter(c < 0.75).groupBy(name.alias("range")).agg(F.count(F.lit(1)).alias("n"))


def lessons(corrections: DataFrame) -> DataFrame:
    """AG42: what each correction teaches: its columns, the pattern's type, its term if it has one, and the order within the correction."""
    deleted, low = F.col("action") == "DELETE", F.lower("target")
    abstract = [F.when(deleted & F.coalesce(F.lower("reasoning").contains("abstract"), F.lit(False)) & low.contains(t), F.struct(F.lit("abstract_as_location").alias("type"), F.lit(t).alias("term"))) for t in ABSTRACT_LEARNT]
    plain = lambda name: F.struct(F.lit(name).alias("type"), F.lit(None).cast("string").alias("term"))
    retyped = (F.col("action") == "RETYPE") & F.contains("relationship", F.lit("part_of")) & F.contains("corrected", F.lit("is"))
    found = F.array(F.when(deleted & any_of(low, VAGUE[:2]), plain("vague_entity_deletion")), *abstract, F.when(retyped, plain("wrong_relation_type_nationality")), F.when(F.col("action") == "REVERSE", plain("reversed_geographic")))
    return corrections.select("*", F.posexplode(F.array_compact(found)).alias("place", "l")).select(*corrections.columns, "place", "l.type", "l.term")


def learn(corrections: DataFrame) -> DataFrame:
    """(type, first, n, term, examples): the patterns, in the order of their first correction, how often each was taught, the term
    of its first lesson and its first examples."""
    order = F.struct("seq", "place")
    rows = lessons(corrections)
    shown = F.struct("seq", "place", "source", "relationship", "target")
    first = rows.groupBy("type").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.min_by("term", order).alias("term"))
    # Examples are cut where they are ranked; all of them are the rows of lessons().
    ranked = rows.withColumn("k", F.expr("row_number() OVER (PARTITION BY type ORDER BY seq, place)")).filter(F.col("k") <= EXAMPLES)
    examples = ranked.groupBy("type").agg(F.transform(F.sort_array(F.collect_list(shown)), lambda x: F.concat_ws(" ", x["source"], x["relationship"], x["target"])).alias("examples"))
    return first.join(examples, "type").select("type", "first", "n", "term", "examples")


def apply(rels: DataFrame, patterns: DataFrame, review: float = REVIEW) -> DataFrame:
    """FLT17: rels with action (DELETE, RETYPE, REVIEW or null), corrected, pattern and pattern_confidence: the pattern learnt first that
    fits counts; a relationship that none fits goes to review below the confidence `review`."""
    row = patterns.select(F.struct("first", "type", "n", "term").alias("p")).agg(F.sort_array(F.collect_list("p")).alias("_patterns"))
    fits = lambda p: (
        ((p["type"] == "vague_entity_deletion") & has("target", VAGUE))
        | ((p["type"] == "abstract_as_location") & F.coalesce(F.contains(F.lower("target"), p["term"]), F.lit(False)) & has("relationship", GEO_STRICT))
        | ((p["type"] == "wrong_relation_type_nationality") & has("relationship", ["part_of"]) & has("target", PEOPLES_LEARNT))
    )
    found = rels.crossJoin(F.broadcast(row)).withColumn("_p", F.get(F.filter("_patterns", fits), 0))
    retype = F.col("_p.type") == "wrong_relation_type_nationality"
    action = F.when(retype, "RETYPE").when(F.col("_p").isNotNull(), "DELETE").when(F.col("confidence") < review, "REVIEW")
    return found.select(*rels.columns, action.alias("action"), F.when(retype, "is").alias("corrected"), F.col("_p.type").alias("pattern"), (F.col("_p.n") / 10).alias("pattern_confidence"))


def report(corrections: DataFrame, most: int = 10) -> DataFrame:
    """AG35: (kind, name, n): corrections by action, and the patterns taught most often."""
    actions = corrections.groupBy(F.col("action").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("action"))
    top = lessons(corrections).groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(most).withColumn("kind", F.lit("pattern"))
    return actions.unionByName(top).select("kind", "name", "n")


def acceptance(rels: DataFrame, docs: DataFrame) -> DataFrame:
    """AG41: (test, value, detail, passed) of relationships (doc_id, doc_sha256, claim_uid, p_true) with their documents (doc_id, text):
    AT-01 the percentage with a hash of their document (95 or more) and how many hashes are no longer the document's, AT-02
    repeated claim ids (none), AT-05 the mean probability (0.5 to 0.95) and the percentage of 0.75 or more (70 or more)."""
    own = rels.join(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("now")), "doc_id", "left")
    hashed, likely = F.col("doc_sha256").isNotNull(), F.col("p_true") >= 0.75
    share = lambda c, of: F.round(100.0 * F.count_if(c) / F.count(of), 4)
    row = own.agg(
        share(hashed, F.lit(1)).alias("coverage"), F.count_if(hashed & (F.col("doc_sha256") != F.coalesce("now", F.lit("")))).cast("double").alias("stale"),
        (F.count("claim_uid") - F.count_distinct("claim_uid")).cast("double").alias("repeated"), F.count("claim_uid").cast("double").alias("uids"),
        F.round(F.avg("p_true"), 6).alias("mean"), share(likely, F.col("p_true")).alias("high"),
    )
    tests = [("AT-01", "coverage", "stale", F.col("coverage") >= 95), ("AT-02", "repeated", "uids", F.col("repeated") == 0), ("AT-05", "mean", "high", F.col("mean").between(0.5, 0.95) & (F.col("high") >= 70))]
    found = F.array(*[F.struct(F.lit(t).alias("test"), F.col(v).alias("value"), F.col(d).alias("detail"), F.coalesce(p, F.lit(False)).alias("passed")) for t, v, d, p in tests])
    return row.select(F.explode(found).alias("t")).select("t.*")
