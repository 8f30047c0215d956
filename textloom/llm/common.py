"""What the training-data operators share: shared storage, bounded batches, words and hashes as flat arrays."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]"
#: Text bytes that a Python worker handles at once.
SLICE_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Hash values of bytes, A-Z as a-z; whether a byte belongs to a word; the base of the polynomial over them and its inverse.
LETTER = mix(np.r_[np.arange(1, 66), np.arange(98, 124), np.arange(92, 257)].astype(np.uint64))
WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LENGTH = np.uint64(0xD1342543DE82EF95)
#: Bytes that are hashed at once; a longer word is hashed by itself.
PIECE = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i below n."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (n + 1) of the words of each text, and the 64-bit hash of each lower-cased (A-Z) word, alike in every process."""
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if at[-1] == at[0]:
        return np.zeros(len(at), np.int64), np.zeros(0, np.uint64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = WORD[data]
    before = np.r_[False, inside[:-1]]
    before[at[:-1][at[:-1] < len(data)]] = False
    first = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False]
    after[at[1:][at[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    h = (end - first).astype(np.uint64) * LENGTH
    short, k = powers(PIECE), 0
    while k < len(h):
        m = max(k + 1, int(np.searchsorted(end, first[k] + PIECE, "right")))
        low, n = first[k], end[m - 1] - first[k]
        up, down = short if n <= PIECE else powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(LETTER[data[low : low + n]] * down[:n], out=total[1:])
        h[k:m] += (total[end[k:m] - low] - total[first[k:m] - low]) * up[first[k:m] - low]
        k = m
    return np.searchsorted(first, at), mix(h)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, as in tests, a new folder in local
    mode, whose driver and executors are one process; on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def keep(df: DataFrame, what: str) -> DataFrame:
    """Writes df into the shared folder and reads it again: lineage ends there and every executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` text bytes; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = (np.cumsum(size, dtype=np.int64) - size) // most
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def compact(texts: pa.Array) -> pa.Array:
    """The same large strings (no nulls) with a first offset of 0: pyarrow's ascii_lower relies on that."""
    if not len(texts):
        return texts
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if at[-1] == at[0]:
        return pa.array([""] * len(texts), pa.large_string())
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).tobytes()), texts.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts, null as empty."""
    return compact(pc.fill_null(batch.column(column).cast(pa.large_string()), ""))


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words of each text: bounds (n + 1), the distinct words, and the code of each word."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    bounds = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds = bounds - bounds[0]
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:
        real = codes != empty
        bounds = np.r_[0, np.cumsum(real)][bounds]
        codes = codes[real]
    return bounds, distinct, codes


def hash_strings(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, alike in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(s) for s in strings.cast(pa.large_binary()).to_pylist()), np.uint64, len(strings))


def give_back() -> None:
    """Hands memory that was freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(f):
    """f, a function of batches for mapInArrow; a worker, which later stages use again, hands back its memory at the end."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def doc_of(bounds: np.ndarray) -> np.ndarray:
    """For each word, the number of its text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def gather(values: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[bounds[c]:bounds[c + 1]] of each code one after another, and where each starts (n + 1)."""
    length = (bounds[1:] - bounds[:-1])[codes]
    ends = np.r_[0, np.cumsum(length)]
    index = np.arange(ends[-1]) + np.repeat(bounds[:-1][codes] - ends[:-1], length)
    return values[index], ends


#: Rows of a few longs that may be broadcast (about 100 MB at most); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether df, which should be stored, has at most `most` rows."""
    return df.limit(most + 1).count() <= most


def row_key(text_col: str = "text"):
    """A hash that tells apart rows with one id and different texts."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("\0")))


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, whose (doc_id, row_key) is not in `dropped`, which should be stored."""
    i, k, z = (fresh(docs, f"_drop_{x}") for x in ("id", "key", "none"))
    gone = dropped.select(F.coalesce(F.col("doc_id"), F.lit(0)).alias(i), F.col("row_key").alias(k), F.col("doc_id").isNull().alias(z)).distinct()
    gone = F.broadcast(gone) if small(dropped) else gone
    own = docs.withColumns({i: F.coalesce(F.col(id_col), F.lit(0)), k: row_key(text_col), z: F.col(id_col).isNull()})
    return own.join(gone, [i, k, z], "left_anti").drop(i, k, z)
