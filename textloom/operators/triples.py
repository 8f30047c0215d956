"""Post-processing of extracted triples and quality predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import any_of

# Predicates of authorship, words that end no title, figurative words, abstract nouns, generic words.
AUTHORSHIP = ("authored", "wrote", "published", "created", "composed", "edited", "compiled", "produced")
BAD_ENDS = ("and", "or", "but", "to", "for", "with", "by", "in", "on", "at", "of", "the", "a", "an")
FIGURATIVE = ("sacred", "magic", "magical", "mystical", "spiritual", "alchemy", "divine", "blessed", "holy", "sanctity", "touch of god", "god's touch", "miracle", "miraculous", "soul", "spirit", "essence", "nexus")
ABSTRACT = ("compass", "journey", "quest", "adventure", "path", "gateway", "portal", "door", "key", "bridge")
GENERIC = ("it", "this", "that", "these", "those", "thing", "stuff", "way", "method")
LOOPS = ("influences", "supports", "relates to", "contains")


def flag(df: DataFrame, name: str, when: Column, factor: float | None = None) -> DataFrame:
    """Adds a flag; rows that it holds for keep the given share of their p_true."""
    df = df.withColumn(name, F.coalesce(when, F.lit(False)))
    return df if factor is None else df.withColumn("p_true", F.when(F.col(name), F.col("p_true") * factor).otherwise(F.col("p_true")))


def authorship(df: DataFrame) -> DataFrame:
    """PP1: a work that is said to have written a person changes places with them."""
    titled = F.col("source").rlike(r":|^(The|A|An) |\b(Handbook|Guide|Book)\b")
    person = F.col("target").rlike(r"^[A-Z][a-z]+( [A-Z][a-z.]+){1,3}$")
    turn = F.lower("relationship").isin(*AUTHORSHIP) & titled & person
    return df.withColumn("reversed", turn).withColumns({"source": F.when(turn, F.col("target")).otherwise(F.col("source")), "target": F.when(turn, F.col("source")).otherwise(F.col("target"))})


def incomplete_title(df: DataFrame) -> DataFrame:
    """PP2."""
    t = F.col("target")
    quotes = F.length(t) - F.length(F.replace(t, F.lit('"'), F.lit("")))
    last = F.lower(F.element_at(F.split(F.trim(t), " +"), -1))
    return flag(df, "incomplete_title", last.isin(*BAD_ENDS) | (quotes == 1) | t.endswith("..."), 0.7)


def invalid_predicate(df: DataFrame) -> DataFrame:
    """PP3: a thing related to itself, or a date as the target."""
    loop = (F.lower("source") == F.lower("target")) & ~F.lower("relationship").isin(*LOOPS)
    return flag(df, "invalid_predicate", loop | F.col("target").rlike(r"^(\d{4}|\d{1,2}/\d{1,2}/\d{2,4})$"), 0.3)


def pronouns(df: DataFrame) -> DataFrame:
    """PP4: he and she become the last capitalised name in `window`, we and our people; others are left unresolved."""
    low = F.lower("source")
    names = F.regexp_extract_all("window", F.lit(r"[A-Z][a-z]+ [A-Z][a-z]+"), F.lit(0))
    name = F.try_element_at(names, F.lit(-1))
    new = F.when(low.isin("he", "she", "him", "her"), name).when(low.isin("we", "us", "our", "ours"), F.lit("humanity"))
    return df.withColumn("unresolved_pronoun", low.isin("he", "she", "him", "her", "it", "they", "we", "us", "our", "ours") & new.isNull()).withColumn("source", F.coalesce(new, F.col("source")))


def context(df: DataFrame) -> DataFrame:
    """PP5: "amount of x" and other vague heads are replaced by what they are about."""
    vague = F.regexp_extract(F.lower("target"), r"^(?:the )?(?:amount|kind|type|part|aspect|process) of (.+)$", 1)
    return df.withColumn("target", F.when(vague != "", vague).otherwise(F.col("target")))


def figurative(df: DataFrame) -> DataFrame:
    """PP7."""
    low = F.lower("target")
    said = F.lower("relationship").isin("is a", "is the", "is-a") & any_of(low, ABSTRACT)
    return flag(df, "figurative", any_of(low, FIGURATIVE) | said, 0.6)


def issues(df: DataFrame) -> DataFrame:
    """FLT14, FLT15, FLT16: names of the quality issues of each triple."""
    bare_number = F.col("target").rlike(r"^[0-9.,]+%?$")
    words = F.split(F.lower("target"), " +")
    there = F.size(F.filter(words, lambda w: F.contains(F.lower("evidence"), w))) / F.size(words)
    found = F.array(F.when(bare_number, F.lit("number without context")), F.when(F.lower(F.trim("source")).isin(*GENERIC) | (F.length("source") < 3), F.lit("generic entity")), F.when(F.lower("source") == F.lower("target"), F.lit("odd")), F.when(there < 0.7, F.lit("not in evidence")))
    return df.withColumn("issues", F.array_compact(found))


def quality_filter(df: DataFrame, least: float, without: tuple[str, ...] = ()) -> DataFrame:
    """FLT7."""
    out = df.filter(F.col("p_true") >= least)
    for name in without:
        out = out.filter(~F.col(name))
    return out


def pass_2_5(df: DataFrame) -> DataFrame:
    """All steps in their fixed order; lists are split by chunking.list_split between context and figurative language."""
    from textloom.operators.chunking import list_split

    df = context(pronouns(invalid_predicate(incomplete_title(authorship(df)))))
    df = df.withColumn("target", F.explode(list_split(F.col("target"))))
    return figurative(df)
