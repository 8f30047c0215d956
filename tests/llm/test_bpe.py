import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from textloom.llm import bpe

TEXTS = [None, "", "  ", "It's we'll aaaa aaaaaaaa", "<|startoftext|>a<|endoftext|>b <|ENDOFTEXT|> <|endoftext|>", "ΣΑΣ ΟΔΟΣ İ Été é", "x" * 30_000, "a\x85b\xa0c\x0bd", "12ab34, (x)!!", "It's"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_padding()
    t.no_truncation()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_as_the_library(spark, library):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "null id", 1), (3, "again", 2)], "doc_id long, text string, ids int")
    out = bpe.digests(docs, bpe.default_path()).collect()
    want = []
    for i, t in [*enumerate(TEXTS), (None, "null id"), (3, "again")]:
        ids, text = expected(library, t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    assert bpe.digests(docs.limit(0), bpe.default_path()).count() == 0


def test_encode_then_decode(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    back = bpe.decode(bpe.encode(docs, bpe.default_path()), bpe.default_path()).collect()
    for r in back:
        ids, text = expected(library, TEXTS[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == text


def test_random_texts_and_forgetting(library, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aeéß tn'1<,\nあ") for _ in range(rng.randrange(60))) for _ in range(400)]
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.vocabulary(bpe.default_path())))
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    for k in range(0, len(texts), 40):
        ids, at, decoded = encoder.batch(pa.array(texts[k : k + 40], pa.large_string()))
        for j, t in enumerate(texts[k : k + 40]):
            assert (ids[at[j] : at[j + 1]].tolist(), decoded[j]) == expected(library, t)


def test_special_tokens_without_a_common_letter(library):
    spec = json.loads(bpe.vocabulary(bpe.default_path()))
    for token, i in (("[PAD]", 0), ("@@", 1)):
        spec["added_tokens"].append({**spec["added_tokens"][0], "id": len(spec["model"]["vocab"]) + i, "content": token})
    data = json.dumps(spec)
    other = Tokenizer.from_str(data)
    other.no_padding()
    other.no_truncation()
    assert other.token_to_id("[PAD]") != other.token_to_id("@@")
    for t in spec["added_tokens"]:
        t["id"] = other.token_to_id(t["content"])
    texts = ["a[PAD]b @@ c", "x@@[PAD]<|endoftext|>y", "plain words", "[pad]"]
    encoder = bpe.Encoder(bpe.Vocabulary(json.dumps(spec).encode()))
    ids, at, decoded = encoder.batch(pa.array(texts, pa.large_string()))
    for k, t in enumerate(texts):
        assert (ids[at[k] : at[k + 1]].tolist(), decoded[k]) == expected(other, t)
    spec["added_tokens"][-1]["content"] = "a b"
    with pytest.raises(ValueError, match="blanks"):
        bpe.Vocabulary(json.dumps(spec).encode())
