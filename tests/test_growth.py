"""Steps that must not grow faster than their input."""

import difflib

import numpy as np

from pyspark.sql import functions as F

from textloom.operators import graph as G
from textloom.operators import communities as C
from textloom.operators import resolution as R
from textloom.operators import vectors as V
from textloom.operators import ward
from textloom.plans import source_suite

RNG = np.random.default_rng(9)


def points(spark, n, dims=8):
    rows = RNG.standard_normal((n, dims))
    return V.units(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(rows)], "id long, vector array<double>"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_not_shuffled_for_each_partner(spark):
    assert "Exchange" not in plan(V.product_pairs(points(spark, 60), 0.9, size=10))


def test_buckets_of_hyperplanes_keep_their_size(spark):
    assert V.bits_for(1_000) == 10 and V.bits_for(64 << 14) == 14
    assert all(n / 2 ** V.bits_for(n) <= V.BUCKET for n in (10**5, 10**6, 10**8))


def test_a_bucket_of_many_rows_is_dealt_into_parts(spark):
    same = spark.range(150).selectExpr("id", "array(1.0D, 0.0D, 0.0D) AS u")
    coded = V.hashed(same, 0.9, 0.95, 10, 1)
    found = [tuple(r) for r in V.in_buckets(coded, 0.9, part=40).collect()]
    assert len(found) == len(set(found)) == 150 * 149 // 2


def test_names_that_share_most_letters_do_not_all_meet(spark):
    names = spark.range(1500).selectExpr("'S' AS type", "format_string('supplier#%09d', id) AS name")
    assert R.near_names(names, 90).count() < 1500 * 1500 / 2 / 10


def test_links_of_names_with_copies(spark):
    names = ["Supplier#000000001", "Supplier#000000002", "supplier#000000013", "abababababa", "bababababab", "abcdefghij", "abcdefghijk", "", "z"]
    rows = [(i, "T", n) for i, n in enumerate([*names, *reversed(names), *names])]
    for least in (90, 60):
        ratio = lambda x, y: 100 * difflib.SequenceMatcher(None, x.lower(), y.lower(), autojunk=False).ratio()
        want = {(i, j): ratio(x, y) for i, _, x in rows for j, _, y in rows if i < j and ratio(x, y) >= least}
        found = {(r.a, r.b): r.ratio for r in R.fuzzy_links(spark.createDataFrame(rows, "id long, type string, name string"), least).collect()}
        assert found.items() <= want.items()
        name = {i: n.lower() for i, _, n in rows}
        assert {(name[i], name[j]) for i, j in found} == {(name[i], name[j]) for i, j in want}
        assert {j for i, j in found if name[i] == name[j]} == set(range(9, 27))


def test_files_share_one_folder(spark, tmp_path):
    rows = spark.range(1050).selectExpr("id AS k", "struct(id AS n) AS o")
    path = source_suite.json_files(rows, str(tmp_path / "lists"))
    assert len(list((tmp_path / "lists").glob("part-*"))) == 11 and not [p for p in (tmp_path / "lists").iterdir() if p.is_dir()]
    assert sorted(r.n for r in spark.read.schema("n long").option("multiLine", True).json(path).collect()) == list(range(1050))


def test_rounds_of_communities_broadcast_nothing(spark):
    links = C.stored(C.symmetric(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double")))
    degrees = C.stored(links.selectExpr("u", "w AS k"))
    assert "Broadcast" not in plan(C.wishes(links, degrees, degrees.selectExpr("u", "u AS a"), 4.0))


def test_equal_vectors_join_in_one_round(spark):
    rows = spark.createDataFrame([(i, [0.0, 0.0] if i < 60 else [float(i), 1.0]) for i in range(64)], "id long, vector array<double>")
    made = ward.joins(rows, small=6).collect()
    assert len(made) == 63 and max(r["round"] for r in made) < 10


def test_path_rounds_read_stored_links_and_the_last_those_to_the_end_only(spark, monkeypatch):
    rows = [("a", f"m{i}", "X") for i in range(5)] + [(f"m{i}", f"k{j}", "X") for i in range(5) for j in range(30)] + [("k7", "z", "X")]
    kept, plain = [], G.stored

    def noted(df):
        kept.append(plain(df))
        return kept[-1]

    monkeypatch.setattr(G, "stored", noted)
    path = G.shortest_path(spark.createDataFrame(rows, "src string, dst string, type string"), "a", "z", 3).first()
    assert (path.hops, path.nodes) == (3, ["a", "m0", "k7", "z"])
    fronts = [x.count() for x in kept if "nodes" in x.columns]
    assert fronts == [1, 5, 30, 1] and any(x.columns == ["src", "dst", "type"] for x in kept)


def test_names_are_distinct_before_their_letters_are_counted(spark):
    from textloom.plans import domain_suite

    rows = domain_suite.names(spark, "/root/testdata/sf0.001").filter(F.size("vector") > 0)
    assert "o_orderpriority" not in rows._jdf.queryExecution().optimizedPlan().toString() and rows.count() > 20


def test_edge_queries_get_more_tasks_with_more_rows(spark, monkeypatch):
    from textloom.plans import edge_suite

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(edge_suite, "ROWS", 1000)
    text = plan(edge_suite.cooccurrence(spark, sf))
    assert f", {-(-n // 1000)}), REPARTITION_BY_NUM" in text and f", {-(-2 * n // 1000)}), REPARTITION_BY_NUM" in text
    pairs, total = edge_suite.supplies(spark, sf)
    assert total == n and pairs.rdd.getNumPartitions() == -(-n // 1000)
    assert pairs.count() == spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().count()
