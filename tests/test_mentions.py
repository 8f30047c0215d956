from textloom.operators import mentions


def test_containing_texts(spark):
    items = [(1, "a quick brown fox jumps"), (2, "fox"), (3, "uick brown fox jumps ov"), (4, " lead and trail here "), (5, None), (6, "x  y\tz w v"), (7, "one two three"), (8, "")]
    docs = [(10, "see a quick brown fox jumps over"), (11, "a quick brown fox jump"), (12, "they lead and trail here too"), (13, "lead and trail here"), (14, None), (15, ""), (16, "ax  y\tz w vb"), (17, "x y z w v"), (18, "stone two threefold"), (18, "stone two threefold")]
    found = mentions.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(i, d) for i, a in items for d, b in docs if a is not None and b is not None and a in b}
    rows = [(r.item_id, r.doc_id) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)
