import numpy as np
import pyarrow as pa

from textloom.llm import common


def test_words_of_slices_are_whole():
    texts = ["É Ab  c\tD", None, "", "ünï x" * 50, "a\x0bB\x0cc\rd e", " ß "] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    seen = []
    for part in common.slices(iter([batch.slice(3), batch.slice(0, 0)]), "text", 40):
        got = common.texts_of(part)
        got.validate(full=True)
        bounds, distinct, codes = common.words_of(got)
        words = [distinct[c].as_py() for c in codes.tolist()]
        for k, text in enumerate(got.to_pylist()):
            lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            want = [w for w in lower.replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
            assert words[bounds[k] : bounds[k + 1]] == want
        seen += part.column("doc_id").to_pylist()
    assert seen == list(range(3, len(texts)))


def test_fresh_names():
    class Frame:
        columns = ["a", "_A", "b"]

    assert common.fresh(Frame, "A") == "__A"


def test_hashed_words_are_the_words(monkeypatch):
    import pyarrow as pa

    from textloom.llm import common

    texts = ["", "a b  A", " \t", "b", "Aé\x0bé a", "x" * 70 + " y", "a b"] * 9
    column = common.compact(pa.array(["cut away", *texts], pa.large_string()).slice(1))
    want = [t.split() for t in ["".join(c.lower() if c < "\x80" else c for c in t) for t in texts]]
    found = []
    for piece in (8, 1 << 18):
        monkeypatch.setattr(common, "PIECE", piece)
        bounds, h = common.hashed_words(column)
        assert np.diff(bounds).tolist() == [len(w) for w in want]
        found.append(h)
    assert (found[0] == found[1]).all()
    name = dict(zip([w for ws in want for w in ws], found[0].tolist()))
    assert len(set(name.values())) == len(name) and [name[w] for ws in want for w in ws] == found[0].tolist()
    bounds, h = common.hashed_words(pa.array([], pa.large_string()))
    assert bounds.tolist() == [0] and not len(h)
