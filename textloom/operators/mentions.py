"""Texts that contain other texts: a join on runs of words instead of a test of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a run.
RUN = 3


def blank_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def run_at(words: Column, at: Column, run: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(run)])


def containing(docs: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """JN7, JN8: (item_id, doc_id): documents (doc_id, text) that contain the text of an item (item_id, text), letter by letter.

    A word of the item that has blanks on both sides is a word of each text that contains it, so the first run of such words
    is looked up among the runs of the documents, and only pairs that share it are tested. Items too short for a run are
    tested against every text: those should be few. Nulls contain nothing and are contained nowhere.
    """
    inner = F.slice(blank_words(F.concat(F.lit("x"), "text", F.lit("x"))), 2, 1 << 30)
    keyed = items.filter("text IS NOT NULL").select("item_id", F.col("text").alias("item"), F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0))).alias("inner"))
    long = keyed.filter(F.size("inner") >= run).select("item_id", "item", run_at(F.col("inner"), F.lit(0), run).alias("key"))
    short = keyed.filter(F.size("inner") < run).select("item_id", "item")
    words = docs.filter("text IS NOT NULL").select("doc_id", "text", blank_words(F.col("text")).alias("w"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - run), lambda k: run_at(F.col("w"), k, run)))
    places = words.filter(F.size("w") >= run).select("doc_id", "text", F.explode(runs).alias("key"))
    found = places.join(long, "key").filter(F.contains("text", "item")).select("item_id", "doc_id")
    return found.unionByName(docs.join(short, F.contains("text", "item")).select("item_id", "doc_id")).distinct()
