import pytest
from pyspark.sql import functions as F

from textloom.sources import vector_store as V


def rows(spark, data):
    return spark.createDataFrame([(n, i, [float(x)], labels) for n, i, x, labels in data], V.ROW)


def found(spark, path):
    return sorted((r.namespace, r.id, r.embedding[0], tuple(r.labels or ())) for r in V.read(spark, path).collect())


def test_upserts_exports_and_merging(spark, tmp_path):
    path = str(tmp_path / "store")
    assert V.read(spark, path).count() == 0
    V.upsert(rows(spark, [("", "a", 1, ["x"]), ("", "b", 2, None), ("books", "a", 3, [])]), path)
    V.upsert(rows(spark, [("", "b", 4, ["y"]), ("books", "c", 5, ["z"])]), path)
    want = [("", "a", 1.0, ("x",)), ("", "b", 4.0, ("y",)), ("books", "a", 3.0, ()), ("books", "c", 5.0, ("z",))]
    assert found(spark, path) == want
    assert V.export(spark, path, str(tmp_path / "lines")) == 4
    V.load(spark, str(tmp_path / "lines"), str(tmp_path / "other"))
    assert found(spark, str(tmp_path / "other")) == want
    V.merge(spark, path)
    assert found(spark, path) == want and len(V.parts(spark, path)[1]) == 1


def test_migration_under_the_lock(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError):
        V.migrate_labels(spark, path, {"old": "new"})
    V.upsert(rows(spark, [("", "a", 1, ["old", "x", "new"]), ("", "b", 2, ["x"]), ("books", "a", 3, None), ("books", "b", 3, ["old"])]), path)
    assert [tuple(r) for r in V.migrate_labels(spark, path, {"old": "new"}, dry_run=True).orderBy("namespace").collect()] == [("", 1), ("books", 1)]
    assert found(spark, path)[0][3] == ("old", "x", "new")
    V.migrate_labels(spark, path, {"old": "new"})
    assert found(spark, path) == [("", "a", 1.0, ("new", "x")), ("", "b", 2.0, ("x",)), ("books", "a", 3.0, ()), ("books", "b", 3.0, ("new",))]
    # The changed rows only are a part of their own; a second pass writes nothing.
    names = V.parts(spark, path)[1]
    assert spark.read.parquet(f"{path}/rows/{names[-1]}").count() == 2
    assert V.migrate_labels(spark, path, {"old": "new"}).agg(F.sum("changed")).first()[0] == 0 and V.parts(spark, path)[1] == names
    with V.writing(spark, path), pytest.raises(RuntimeError):
        V.upsert(rows(spark, [("", "c", 1, [])]), path)
    assert len(found(spark, path)) == 4
    V.upsert(rows(spark, [("", "c", 1, [])]), path)
    assert len(found(spark, path)) == 5
