import pytest
from pyspark.sql import functions as F

from textloom.operators import stages as S

CALLS = []


def noted(name, fail=False):
    def apply(rows, **how):
        CALLS.append(name)
        if fail:
            raise RuntimeError(name)
        return rows.withColumn(name, F.lit(how.get("by", 1)) * F.col("id"))

    return apply


def plan(broken=False, by=2):
    return [("first", noted("first"), {}), ("second", noted("second"), {"by": by}), ("third", noted("third", broken), {})]


def test_a_broken_run_goes_on(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    docs, path = spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "job")
    assert [r.finished for r in S.progress(spark, docs, plan(), path).orderBy("place").collect()] == [False] * 3
    CALLS.clear()
    with pytest.raises(RuntimeError):
        S.run(docs, plan(broken=True), path)
    assert CALLS == ["first", "second", "third"]
    # What a killed writer left has no row in the manifest: it is written over.
    key = S.keys(S.fingerprint(docs), plan())[2]
    spark.range(99).write.parquet(f"{path}/stages/third-{key}")
    out = S.run(docs, plan(), path)
    assert CALLS[3:] == ["third"] and sorted(map(tuple, out.collect())) == [(i, i, 2 * i, i) for i in range(5)]
    assert [(r.stage, r.finished, r.rows) for r in S.progress(spark, docs, plan(), path).orderBy("place").collect()] == [(s, True, 5) for s in ("first", "second", "third")]
    S.run(docs, plan(), path)
    assert CALLS[4:] == []


def test_changed_parameters_and_input_start_anew(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "job")
    S.run(spark.read.parquet(str(tmp_path / "in")), plan(), path)
    CALLS.clear()
    S.run(spark.read.parquet(str(tmp_path / "in")), plan(by=3), path)
    assert CALLS == ["second", "third"]
    spark.range(5, 7).write.mode("append").parquet(str(tmp_path / "in"))
    out = S.run(spark.read.parquet(str(tmp_path / "in")), plan(), path)
    assert CALLS[2:] == ["first", "second", "third"] and out.count() == 7
    S.run(spark.read.parquet(str(tmp_path / "in")), plan(), path, version="2")
    assert CALLS[5:] == ["first", "second", "third"]
