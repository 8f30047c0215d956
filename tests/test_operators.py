import difflib
import pandas as pd
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import chunking as C
from textloom.operators import graph as G
from textloom.operators import packing
from textloom.operators import resolution as R
from textloom.operators import search as S
from textloom.operators import triples as P
from textloom.sources import files
from textloom.streaming import streams


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("r")).first().r


def test_bm25_floor_and_repeated_terms(spark):
    docs = spark.createDataFrame([(1, "apple apple pear"), (2, "apple plum"), (3, "apple kiwi fig"), (4, "")], "doc_id long, text string")
    once = dict(map(tuple, S.bm25(docs, ["apple", "pear"]).collect()))
    twice = dict(map(tuple, S.bm25(docs, ["pear", "pear"]).collect()))
    assert max(once, key=once.get) == 1 and set(twice) == {1}
    assert abs(twice[1] / dict(map(tuple, S.bm25(docs, ["pear"]).collect()))[1] - 2) < 1e-9


def test_cosine_of_a_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.7071]


def test_packing_and_windows(spark):
    assert one(spark, "aa bb cc dddddddd e", lambda t: C.packed(F.split(t, " "), 5)) == ["aa bb", "cc", "dddddddd", "e"]
    docs = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, ""), (3, None)], "doc_id long, text string")
    assert [r.start for r in C.word_windows(docs, 10, 2).orderBy("start").collect()] == [0, 8, 16, 24]
    assert [r.start for r in C.word_windows(docs, 10, 2, True).orderBy("start").collect()] == [0, 8, 16]
    pages = spark.createDataFrame([(1, 1, "a b c d"), (1, 2, "x"), (1, 3, "e f g h")], "doc_id long, page int, text string")
    out = packing.page_windows(pages, 5, 1, 2).orderBy("start").collect()
    assert (out[0].pages, out[0].chunk) == ([1, 3], "a b c d e")


def test_speaker_turns_and_formats(spark):
    assert one(spark, "intro\n0:01 – Ann hello 0:09 – Bob hi", C.speaker_turns) == ["0:01 – Ann hello ", "0:09 – Bob hi"]
    assert one(spark, "Ann: hello\nBob: hi", C.speaker_format) == "colon" and one(spark, "none", C.speaker_format) is None


def test_recursive_split_keeps_words_and_size():
    text = "First part. " * 30 + "\n\n" + "word " * 200
    parts = C._split(text, 100, 20, ("\n\n", "\n", ". ", " "))
    assert all(len(p) <= 100 for p in parts) and {w for p in parts for w in p.replace(".", "").split()} == {"First", "part", "word"}


def test_segments_are_packed_with_overlap(spark):
    rows = spark.createDataFrame([(1, float(k), k + 1.0, "x" * 40) for k in range(6)], "episode long, start double, end double, text string")
    out = packing.segment_chunks(rows, 130, 1).orderBy("chunk_index").collect()
    assert [(r.start, r.end) for r in out] == [(0.0, 3.0), (2.0, 5.0), (4.0, 6.0)] and out[0].chunk_total == 3


def test_lists_and_labels(spark):
    assert one(spark, "soil, water, Soil and clean air", C.list_split) == ["soil", "water", "clean air"]
    df = spark.createDataFrame([(["A", "old", "A"],), (None,), ([],)], "l array<string>").select(X.rewrite_labels(F.col("l"), {"old": "new"}).alias("r"))
    assert [r.r for r in df.collect()] == [["A", "new"], None, []]
    again = df.select(X.rewrite_labels(F.col("r"), {"old": "new"}).alias("r"))
    assert [r.r for r in again.collect()] == [["A", "new"], None, []]


def test_scalar_functions(spark):
    assert one(spark, "Chris is a farmer. He", lambda t: X.guest_name(t, F.lit(""))) == "Chris"
    assert one(spark, "a  b\n12\nxy\nlong line", X.clean_pdf_text) == "a b\nlong line"
    assert one(spark, "Episode 12 – Ann Lee on Soil on Earth", X.guest_topic).asDict() == {"guest": "Ann Lee", "topic": "Soil on Earth"}
    assert one(spark, "see **this** [x](http://a.b) [1]", X.speech_text) == "see this x." and one(spark, 'a<b & "c"', X.html_escape) == "a&lt;b &amp; &quot;c&quot;"
    assert one(spark, "EPISODE 7 rocks", X.episode_number) == 7 and one(spark, "no", X.episode_number) is None
    assert one(spark, "the usa and friends of earth", X.smart_capitalize) == "The USA and Friends of Earth"
    assert round(one(spark, "x", lambda t: X.p_true(F.lit(1.0), F.lit(1.0), F.lit(0.5), F.lit(False))), 10) == 0.8909031788
    df = spark.createDataFrame([("MARTHA", "MARHTA"), ("abc", "abc"), ("abc", None)], "a string, b string")
    assert [r[0] if r[0] is None else round(r[0], 4) for r in df.select(X.jaro_winkler("a", "b")).collect()][:2] == [0.9611, 1.0]
    assert one(spark, "Ｓoil—Health!", X.canon) == "soil health"


def test_triples(spark):
    rows = [("Soil: A Guide", "wrote", "Jane Doe", 0.9, "", "Soil: A Guide by Jane Doe"), ("it", "is", "sacred soil", 0.8, "", ""), ("farm", "has", "2010", 1.0, "", ""), ("he", "grows", "apples, pears and plums", 0.9, "met John Smith here", "apples pears plums")]
    df = spark.createDataFrame(rows, "source string, relationship string, target string, p_true double, window string, evidence string")
    out = P.pass_2_5(df).collect()
    by = {(r.source, r.target): r for r in out}
    assert by["Jane Doe", "Soil: A Guide"].reversed and by["it", "sacred soil"].unresolved_pronoun
    assert round(by["it", "sacred soil"].p_true, 3) == 0.48 and round(by["farm", "2010"].p_true, 3) == 0.3
    assert {t for s, t in by if s == "John Smith"} == {"apples", "pears", "plums"}
    assert P.quality_filter(P.pass_2_5(df), 0.5, ("figurative",)).count() == 4
    assert "number without context" in P.issues(df).filter("target = '2010'").first().issues


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "a", "y"), ("c", "d", "x"), ("p", "q", "x"), ("s", "s", "x")], "src string, dst string, type string")
    assert dict(map(tuple, G.connected_components(e).collect())) == {"a": "a", "b": "a", "c": "a", "d": "a", "p": "p", "q": "p", "s": "s"}
    assert {r.id for r in G.cycle_nodes(e).collect()} == {"a", "b", "c", "s"}
    path = G.shortest_path(e, "b", "d").first()
    assert (path.hops, path.nodes) == (2, ["b", "c", "d"]) and G.shortest_path(e, "a", "p", 3).count() == 0
    assert dict(map(tuple, G.bfs(e, "a", 1, directed=True).collect())) == {"a": 0, "b": 1}


def test_resolution(spark):
    people = spark.createDataFrame([(1, "P", "Jane Doe"), (2, "P", "Jane  Doe"), (3, "P", "Zed"), (4, "Q", "Jane Doe")], "id long, type string, name string")
    assert [(r.a, r.b) for r in R.fuzzy_pairs(people).collect()] == [(1, 2)]
    assert dict(map(tuple, R.greedy_clusters(people).collect())) == {1: 1, 2: 1, 3: 3, 4: 4}
    names = spark.createDataFrame([("Soil Health",), ("soil health",), ("Soil Health",)], "name string")
    assert {r.canonical for r in R.alias_groups(names).collect()} == {"Soil Health"}
    places = spark.createDataFrame([("Boulder", 108090, ["US", "CO"], 40.0, -105.3, "City"), ("Lafayette", 30411, ["US", "CO"], 40.0, -105.1, "City")], "name string, population long, admin_path array<string>, lat double, lon double, type string")
    rels = spark.createDataFrame([("Boulder", "located_in", "Lafayette", 0.9), ("X", "located_in", "Boulder", 0.9)], "source string, relationship string, target string, p_true double")
    out = {r.source: r for r in R.geo_validate(rels, places).collect()}
    assert out["Boulder"].swap and out["Boulder"].valid is False and out["X"].valid is None and round(out["X"].adjusted, 2) == 0.85


def test_budget_accepts_exactly_three(spark):
    rows = [(f"2024-01-01 00:00:{k:02d}", "reserve", 0.0) for k in range(50)] + [("2024-01-02 00:00:00", "reserve", 0.0)]
    df = spark.createDataFrame(rows, "ts string, kind string, cost double").withColumn("ts", F.to_timestamp("ts"))
    assert {r.day: (r.accepted, r.denied) for r in streams.budget(df, 0.09).collect()} == {"2024-01-01": (3, 47), "2024-01-02": (1, 0)}


def test_streams_give_what_their_batch_twins_give(spark, tmp_path):
    rows = [(k, f"2024-01-01 {k % 24:02d}:{k % 60:02d}:00", k % 5, "click" if k % 3 else "view", float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.parquet_stream(spark, str(tmp_path / "in"), df.schema)
    q = streams.counters(stream).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, streams.counters(df).collect()))
    q = streams.append_by_day(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
    assert streams.tumbling(df).agg(F.sum("n")).first()[0] == 200


def test_file_sources(spark, tmp_path):
    (tmp_path / "e1.json").write_text('{"episode_number": "1", "title": "T", "full_transcript": "' + "word " * 40 + '"}')
    (tmp_path / "e2.json").write_text('{"episode_number": "63-x", "full_transcript": "short"}')
    (tmp_path / "e3.json").write_text("{broken")
    assert [r.episode_number for r in files.episodes(spark, str(tmp_path / "e*.json")).collect()] == ["1"]
    (tmp_path / "c.csv").write_text("a,,,,,\nid,t,u,v,w,Soil,Water\n1,t,,,,X,\nbad,t,,,,X,X\n2,t,,,,x,X\n3,t\n")
    assert sorted(map(tuple, files.categories(spark, str(tmp_path / "c.csv")).collect())) == [(1, "Soil"), (2, "Soil"), (2, "Water")]
    (tmp_path / "t.json").write_text('{"pillars": {"P": {"c": "about c"}}}')
    assert list(map(tuple, files.taxonomy(spark, str(tmp_path / "t.json")).collect())) == [("P", "c", "about c")]
    lines = spark.createDataFrame([('{"a": 1}',), ("{broken",), ("",), ('{"a": 2}',)], "value string")
    assert [r.a for r in files.ndjson(lines, "a int").collect()] == [1, 2]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, files.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], old.schema), "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert files.export_jsonl(old, str(tmp_path / "x")) == 2


def test_callable_over_batches(spark):
    df = spark.range(5)
    assert C.batches_through(df, lambda f: pd.DataFrame({"y": f.id * 2}), "y long").agg(F.sum("y")).first()[0] == 20


def test_fuzzy_pairs_are_all_pairs(spark):
    names = ["Supplier#000000001", "Supplier#000000002", "Supplier#000000013", "upplier#000000001", "xSupplier#000000001", "a", "A", "b", "", "", None, "ab", "abababababa", "bababababab", "abcdefghij", "zbcdefghijk", "abcdefghijk", "bcdefghijka"]
    rows = [(k, "PQ"[k % 5 == 4], n) for k, n in enumerate(names * 2)]
    df = spark.createDataFrame(rows, "id long, type string, name string")
    for least in (90, 60):
        want = {(i, j) for i, s, x in rows for j, t, y in rows if i < j and s == t and x is not None and y is not None and 100 * difflib.SequenceMatcher(None, x.lower(), y.lower(), autojunk=False).ratio() >= least}
        found = [(r.a, r.b) for r in R.fuzzy_pairs(df, least).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_best_window_tries_every_place(spark):
    import random

    rng = random.Random(4)

    def brute(text, words, width):
        best, start = 0, 0
        places = [p for w in words for p in range(len(text)) if text.lower().startswith(w, p)]
        if not places:
            return text[:width]
        for s in sorted({max(0, p - width // 2) for p in places}):
            score = sum(text[s : s + width].lower().count(w) for w in words)
            if score > best:
                best, start = score, s
        part = text[start : start + width]
        stop = part.rfind(".")
        return part[: stop + 1] if stop > len(part) * 0.8 else part

    rows = [(" ".join(rng.choice(["soil", "Moss", "fern.", "stone", "sea", "annana"]) for _ in range(rng.randrange(80))), ["moss", "ana"]) for _ in range(60)] + [("", ["a"]), (None, ["a"]), ("plain text", []), ("plain text", None)]
    df = spark.createDataFrame(rows, "t string, w array<string>")
    found = [r.p for r in df.select(X.best_window(F.col("t"), F.col("w"), 60).alias("p")).collect()]
    assert found == [None if t is None else brute(t, w or [], 60) for t, w in rows]


def test_population_reversals(spark):
    rels = [("Boulder county", "located_in", "Lafayette"), ("Lafayette", "located_in", "Boulder"), ("Boulder", "knows", "Lafayette"), (" ", "in", "Boulder"), (None, "in", None)]
    places = spark.createDataFrame([("boulder", 108090), ("lafayette", 30411)], "name string, population long")
    found = R.population_reversals(spark.createDataFrame(rels, "source string, relationship string, target string"), places).collect()
    assert [(r.source, r.target, r.suggested_fix) for r in found] == [("Boulder county", "Lafayette", "REVERSE_RELATIONSHIP")]


def test_validated_pairs_are_new_and_replays_change_nothing(spark, tmp_path):
    for rows in ([(1, 2), (2, 1), (3, 3), (None, 4)], [(2, 1), (5, 4)]):
        spark.createDataFrame(rows, "a long, b long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.parquet_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "a long, b long").schema)
        streams.validated_pairs(stream, str(tmp_path / "out"), "a", "b").awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out" / "pairs"))
    assert sorted(map(tuple, found.collect())) == [(1, 2, 0), (3, 3, 0), (4, 5, 1)]
