import random

from tokenizers import Tokenizer

import corpus_pipeline
from textloom.llm import bpe

RNG = random.Random(12)
VOCAB = ["".join(RNG.choice("etaoinshrdlu") for _ in range(RNG.randrange(2, 8))) for _ in range(800)]
BAD = ["grumblix", "snarkel", "zogfool"]


def prose(n):
    return RNG.choices(VOCAB, k=n)


def test_stages_follow_what_was_planted(spark, tmp_path):
    items = [prose(30) for _ in range(5)]
    docs, toxic, gone = [], [], set()

    def put(words, drop=False):
        i = len(docs)
        docs.append((i, " ".join(words) if words is not None else None, "en", "src0", 0))
        if drop:
            gone.add(i)
        return i

    for k in range(400):
        words = prose(RNG.randrange(40, 120))
        if k % 5 == 0:
            for _ in range(10):
                words.insert(RNG.randrange(len(words)), RNG.choice(BAD))
            toxic.append(put(words, True))
        else:
            put(words)
    clean = [d[0] for d in docs if d[0] not in gone]
    for i in clean[:20]:  # copies with other white space: the longer text stays
        gone.add(i)
        put(docs[i][1].replace(" ", "  ").split(" "))
    for i in clean[40:60]:  # near copies: the smaller id stays
        words = docs[i][1].split()
        words[len(words) // 2] = "changed"
        put(words, True) if len(words) > 90 else None
    for k in range(15):
        put([*prose(20), *items[k % 5], *prose(20)], True)
    put(None)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in set(toxic))) for i in range(0, 400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {d[0] for d in docs} - gone and len(out) == len({r.doc_id for r in out})
    library = Tokenizer.from_file(bpe.default_path())
    text = {d[0]: d[1] or "" for d in docs}
    assert all(r.ids == library.encode(text[r.doc_id], add_special_tokens=False).ids for r in out[:50])


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rows = spark.createDataFrame([(k, " ".join(prose(30)), "en", "s", 1, "extra") for k in range(6)], "doc_id long, text string, lang string, source string, n_chars long, N_Shingles string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for empty in (False, True):
        docs = rows.limit(0) if empty else rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == rows.columns, name
            assert docs.count() == (0 if empty else 6), name
