"""BPE encoding and decoding by batched numpy merge rounds.

A vocabulary file of the public `tokenizers` format is read on the driver (its path is a parameter) and broadcast: its
size is fixed by the file. Texts are cut at blanks, the distinct pieces of a batch are split into pre-tokens, and the
symbols of all their words stand in one flat array. Each round finds every adjacent pair's rank by binary search over
the sorted pair keys, takes the lowest rank of each word and merges all its places at once, leftmost first.

Supported form: normaliser NFC, white space, lower case; a regular-expression split; byte-level symbols with a word-end
suffix; no decoder (tokens are joined by a space). Another form is refused.

Defined results: null counts as the empty text, which has no token; texts are never cut; special tokens written in a
text get their own ids, as the library does by default; repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from textloom.llm.common import gather, released, slices, table, texts_of

NONE = np.iinfo(np.int64).max
#: Letters of pieces that a worker remembers before it starts anew.
REMEMBERED = 1 << 20
#: Text bytes that are encoded at once.
SLICE = 1 << 19


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """Sorted pair keys with their ranks and products, first symbols, and the pre-tokeniser of a vocabulary file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or level["type"] != "ByteLevel" or level["use_regex"] or spec["decoder"]:
            raise ValueError("this form of vocabulary is not supported")
        vocab = model["vocab"]
        end = model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        letters = byte_letters()
        self.first = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(not x or any(c in " \t\n\v\f\r" for c in x) for x in self.special):
            raise ValueError("special tokens with blanks are not supported")
        # A letter that every special token has, or the empty string, which every piece has.
        self.sign = min(set.intersection(*map(set, self.special)), default="") if self.special else ""
        self.marks = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}

    def words(self, piece: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if piece.isascii():
            if piece.isalpha():
                return [piece.lower()]
        else:
            # Letters are lower-cased one by one: a final sigma is not special.
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        return self.pattern.findall(piece.lower())

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty words as one flat array, and where each word starts (n + 1)."""
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(length)
        symbols = self.first[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(raw)), length)
        done_symbols, done_words = [], []
        while len(symbols):
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], NONE)
            rank = np.r_[rank, NONE]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(word)]))
            over = low == NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                symbols, word, rank, low = symbols[~over], word[~over], rank[~over], low[~over]
                if not len(symbols):
                    break
            hit = rank == low
            # Of places that overlap (one symbol twice), every second from the left of their run is merged.
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, -1))
            hit &= (place - run) % 2 == 0
            at = np.flatnonzero(hit)
            found = np.searchsorted(self.keys, symbols[at] << 32 | symbols[at + 1])
            symbols[at] = self.made[found]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            symbols, word = symbols[stays], word[stays]
        if not done_words:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        word = np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_symbols)[order], np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces as one flat array, and where each piece starts (n + 1)."""
        known: dict[str, int] = {}
        special: dict[int, int] = {}
        parts: list[int] = []
        counts = np.zeros(len(pieces), np.int64)
        for k, piece in enumerate(pieces):
            before = len(parts)
            if self.marks is not None and self.sign in piece:
                for n, x in enumerate(self.marks.split(piece)):
                    if n % 2:
                        code = known.setdefault(f"{x} ", len(known))  # no word holds a space
                        special[code] = self.special[x]
                        parts.append(code)
                    else:
                        parts += [known.setdefault(w, len(known)) for w in self.words(x)]
            else:
                parts += [known.setdefault(w, len(known)) for w in self.words(piece)]
            counts[k] = len(parts) - before
        ids, at = self.merge([w if c not in special else "x" for w, c in known.items()])
        if special:
            keep = np.ones(len(ids), bool)
            for c, i in special.items():
                ids[at[c]] = i
                keep[at[c] + 1 : at[c + 1]] = False
            at = np.r_[0, np.cumsum(keep)][at]
            ids = ids[keep]
        flat, ends = gather(ids, at, np.array(parts, np.int64))
        return flat, ends[np.r_[0, np.cumsum(counts)]]

    def text(self, ids: np.ndarray) -> str:
        return " ".join([self.tokens[i] for i in ids.tolist()])


class Encoder:
    """Encodes batches of texts; remembers short pieces between batches. Without `shows` it decodes nothing."""

    def __init__(self, vocabulary: Vocabulary, shows: bool = True):
        self.vocabulary, self.shows = vocabulary, shows
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.size = 0
        self.ids, self.at, self.shown = [np.zeros(0, np.int64)], [0], []

    def learn(self, pieces: list[str]) -> None:
        ids, at = self.vocabulary.encode(pieces)
        base = self.at[-1]
        self.ids.append(ids)
        self.at += (at[1:] + base).tolist()
        if self.shows:
            tokens = [self.vocabulary.tokens[i] for i in ids.tolist()]
            self.shown += [" ".join(tokens[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for p in pieces:
            self.code[p] = len(self.code)
            self.size += len(p)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts as one flat array, where each text starts (n + 1), and each text decoded again (if it shows)."""
        parts = pc.ascii_split_whitespace(texts)
        bounds = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds -= bounds[0]
        distinct = coded.dictionary.to_pylist()
        if self.size > REMEMBERED:
            self.forget()
        self.learn([p for p in distinct if p not in self.code])
        local = np.fromiter((self.code[p] for p in distinct), np.int64, len(distinct))
        codes = local[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.int64)
        self.ids = [np.concatenate(self.ids)]
        ids, ends = gather(self.ids[0], np.array(self.at), codes)
        if not self.shows:
            return ids, ends[bounds], []
        shown, as_list, b = self.shown, codes.tolist(), bounds.tolist()
        decoded = [" ".join(filter(None, [shown[c] for c in as_list[i:j]])) for i, j in zip(b[:-1], b[1:], strict=True)]
        return ids, ends[bounds], decoded


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def over(df: DataFrame, path: str, schema: str, make: Callable, text_col: str = "text", columns: list[str] | None = None, shows: bool = True) -> DataFrame:
    """Applies make(batch, ids, bounds, decoded) -> RecordBatch to each batch of encoded texts."""
    data = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(data.value), shows)
        for batch in slices(batches, text_col, SLICE):
            yield make(batch, *encoder.batch(texts_of(batch, text_col)))

    return df.select(*columns or [f"`{c}`" for c in df.columns]).mapInArrow(released(run), schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the ids of each text."""

    def make(batch, ids, bounds, decoded):
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "n_tokens", "ids"])

    return over(docs, path, "doc_id long, n_tokens long, ids array<int>", make, text_col, [id_col, text_col], shows=False)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """tokens with the column `decoded`; null ids give the empty text."""
    data = tokens.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        known = Vocabulary(data.value)
        for batch in batches:
            shown = [known.text(np.array(x or [], np.int64)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shown, pa.string())], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian, 32 bits each) and of the decoded text."""

    def make(batch, ids, bounds, decoded):
        raw = ids.astype("<u4")
        b = bounds.tolist()
        return pa.RecordBatch.from_arrays(
            [
                batch.column(id_col), pa.array(np.diff(bounds)),
                pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(b[:-1], b[1:], strict=True)], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return over(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make, text_col, [id_col, text_col])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path())
