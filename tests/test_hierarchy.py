"""Hierarchies of any depth, lone clusters taken in, feeds and wiki pages as files."""

import datetime

from textloom.operators import graph as G
from textloom.sources import files


def test_paths_of_any_depth(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(90)]
    odd = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("lost", "nowhere"), ("below", "lost"), ("root", None)]
    rows = spark.createDataFrame(chain + odd, "id string, parent_id string")
    found = {r.id: (r.depth, r.path) for r in G.hierarchy_paths(rows).collect()}
    assert found == {f"n{i}": (i, "/".join(f"n{k}" for k in range(i + 1))) for i in range(90)} | {"root": (0, "root")}
    assert G.hierarchy_paths(rows.limit(0)).count() == 0


def test_lone_clusters_are_taken_in(spark):
    rows = [("g1", None, 0.0, 0.0), ("g2", None, 10.0, 0.0), ("c1", "g1", 1.0, 1.0), ("c2", "g2", 9.0, 9.0), ("near2", None, 8.0, 0.0), ("tie", None, 5.0, 0.0), ("near1", None, -4.0, 2.0)]
    df = spark.createDataFrame(rows, "id string, parent_id string, x double, y double")
    assert {r.id: r.parent_id for r in G.adopted(df).collect()} == {"g1": None, "g2": None, "c1": "g1", "c2": "g2", "near2": "g2", "tie": "g1", "near1": "g1"}
    alone = df.filter("parent_id IS NULL")
    assert {r.parent_id for r in G.adopted(alone).collect()} == {None}


def test_feed_items(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        """<?xml version="1.0"?><rss><channel><title>Pods</title>
        <item><title>Episode 7: Soil &amp; moss</title><link>https://a.example/7</link><pubDate>Tue, 03 Jan 2023 10:00:00 +0000</pubDate><enclosure url="7.mp3" length="1"/></item>
        <item><link>untitled</link></item>
        <item><title>Trailer</title><pubDate>soon</pubDate></item></channel></rss>"""
    )
    found = {r.title: r for r in files.rss(spark, str(tmp_path / "feed.xml")).collect()}
    assert set(found) == {"Episode 7: Soil & moss", "Trailer"} and found["Trailer"].published is None
    seven = found["Episode 7: Soil & moss"]
    assert (seven.link, seven.audio, seven.published) == ("https://a.example/7", "7.mp3", datetime.datetime(2023, 1, 3, 10))
    known = spark.createDataFrame([(3,)], "episode long")
    assert [r.episode for r in files.feed_items(files.rss(spark, str(tmp_path / "feed.xml")), known).collect()] == [7]


def test_wiki_pages(spark, tmp_path):
    entities = spark.createDataFrame([("a", "Anna Bell", "Person", "A guest"), ("b", "Soil: the book", "Concept", None)], "id string, name string, type string, description string")
    edges = spark.createDataFrame([("a", "b", "MENTIONS"), ("a", "b", "MENTIONS"), ("a", "x", "KNOWS")], "src string, dst string, type string")
    pages = {(r.folder, r.file): r.body for r in files.wiki_pages(entities, edges).collect()}
    body = next(b for (f, n), b in pages.items() if f == "persons" and n != "Index.md")
    assert body == "# Anna Bell\n\nA guest\n\n## Links\n\n- MENTIONS: [[Soil: the book]]\n"
    assert pages["concepts", "Index.md"] == "# Concept (1)\n\n- [[Soil: the book]]\n" and len(pages) == 4
    files.write_pages(files.wiki_pages(entities, edges), str(tmp_path / "wiki"))
    found = spark.read.text(str(tmp_path / "wiki"), wholetext=True)
    assert {(r.folder, r.file): r.value.rstrip("\n") for r in found.collect()} == {k: b.rstrip("\n") for k, b in pages.items()}
