"""Chunking: windows, packing, speaker turns, chapters and list splitting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

TAG, COLON = r"\d+:\d{2} [–-] ", r"(?m)^[A-Z][A-Za-z .]+:"


def word_windows(docs: DataFrame, size: int = 800, overlap: int = 100, stop_at_end: bool = False) -> DataFrame:
    """CH6; CH8 with stop_at_end: windows of words with overlap, by start; stop_at_end leaves out windows that begin after the last word is covered."""
    words = F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != "")
    rows = docs.select("doc_id", words.alias("w")).filter(F.size("w") > 0)
    last = F.size("w") - 1
    if stop_at_end:
        last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / (size - overlap)).cast("int") * (size - overlap))
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last, F.lit(size - overlap))).alias("start"))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.array_join(F.slice("w", F.col("start") + 1, F.lit(size)), " ").alias("chunk"))


def packed(parts: Column, most: int, joint: str = " ") -> Column:
    """WN8, CH9: greedy packing of ordered parts into texts of at most `most` letters; a longer part stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc, x):
        now, done = acc["now"], acc["done"]
        fits = (now == "") | (F.length(now) + len(joint) + F.length(x) <= most)
        grown = F.when(now == "", x).otherwise(F.concat(now, F.lit(joint), x))
        return F.struct(F.when(fits, done).otherwise(F.array_append(done, now)).alias("done"), F.when(fits, grown).otherwise(x).alias("now"))

    return F.aggregate(parts, start, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.array_append(a["done"], a["now"])))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"([.!?]) ", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")


def speaker_format(text: Column) -> Column:
    """CH2."""
    return F.when(text.rlike(TAG), "timestamp").when(text.rlike(COLON), "colon")


def speaker_turns(text: Column) -> Column:
    """CH3: turns that begin with a speaker tag; text before the first tag is left out."""
    marked = F.regexp_replace(text, f"({TAG}|{COLON})", "\u0001$1")
    return F.when(speaker_format(text).isNull(), F.array(text)).otherwise(F.slice(F.split(marked, "\u0001"), 2, 1 << 30))


def chapters(docs: DataFrame, heading: str = r"^(Chapter|CHAPTER) \w+", least: int = 200) -> DataFrame:
    """CH5: lines are numbered, headings counted along them, and the lines of a chapter joined."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.col("line").rlike(heading) & (F.length("line") < 100)
    w = Window.partitionBy("doc_id").orderBy("pos")
    lines = lines.withColumn("chapter", F.sum(head.cast("int")).over(w))
    out = lines.groupBy("doc_id", "chapter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"), (F.min("pos") / 50).cast("int").alias("page"))
    return out.filter(F.length("content") > least)


def _split(text: str, size: int, overlap: int, marks: tuple[str, ...]) -> list[str]:
    mark = next((m for m in marks if m in text), "")
    parts = [p for p in (text.split(mark) if mark else list(text)) if p]
    out: list[str] = []
    now: list[str] = []

    def flush():
        nonlocal now
        if now:
            out.append(mark.join(now))
        while now and (sum(map(len, now)) + len(mark) * (len(now) - 1) > overlap):
            now = now[1:]

    for p in parts:
        if len(p) > size and len(marks) > 1:
            flush()
            now = []
            out += _split(p, size, overlap, marks[marks.index(mark) + 1 :] if mark in marks else marks[-1:])
            continue
        if now and sum(map(len, now)) + len(mark) * len(now) + len(p) > size:
            flush()
            while now and sum(map(len, now)) + len(mark) * len(now) + len(p) > size:
                now = now[1:]
        now.append(p)
    if now:
        out.append(mark.join(now))
    return out


def recursive_split(size: int = 500, overlap: int = 50, marks: tuple[str, ...] = ("\n\n", "\n", ". ", " ")):
    """CH1: a pandas UDF that splits by the coarsest mark and recurses into parts that are too long."""

    @F.pandas_udf(ArrayType(StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _split(t, size, overlap, marks) if t else [])

    return split


def list_split(text: Column) -> Column:
    """PP6: members of an enumeration, the first of equal ones (whatever their case); other texts alone."""
    commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    listed = (commas > 0) & (text.contains(" and ") | (commas >= 2)) & (F.length(text) >= 15)
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, r",? and ", ","), ","), lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(parts, lambda x: F.lower(x))
    return F.when(listed, F.filter(parts, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)).otherwise(F.array(text))


def batches_through(df: DataFrame, function, schema: str) -> DataFrame:
    """UD1, UD2: rows in batches through a supplied callable (a model, an embedder) that takes and gives pandas frames."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield function(frame)

    return df.mapInPandas(run, schema)
