"""The budget stream: the counter's rules, days, restarts, and its batch twin."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from textloom.streaming import budgets, streams

SCHEMA = "event_id long, ts timestamp, kind string, duration_seconds double, upload_bytes double"


def at(day, seconds):
    return datetime.datetime(2024, 1, day, tzinfo=datetime.UTC).replace(tzinfo=None) + datetime.timedelta(seconds=seconds)


def test_counter():
    day = budgets.Day(spent=0.10)
    assert day.event("reserve", None, None, 0.10) == (False, 0.0) and day.denied == 1
    day = budgets.Day(spent=0.09)
    assert day.event("reserve", None, None, 0.10)[0] and day.spent == pytest.approx(0.12)
    assert not day.event("reserve", None, None, 0.10)[0]
    for seconds, size, want in ((15.0, None, 0.006), (600.0, None, 0.06), (None, 16_000 * 60, 0.006), (None, 16_000 * 60 + 1, 0.012), (None, None, 0.03), (float("nan"), 0, 0.03)):
        day = budgets.Day()
        day.event("reserve", None, None, 1.0)
        day.event("reconcile", seconds, size, 1.0)
        assert day.spent == pytest.approx(want)
    day.event("refund", None, None, 1.0)
    assert day.spent == 0


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def go(spark, tmp_path, budget=0.10):
    stream = streams.parquet_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    q = budgets.run(stream, budget, str(tmp_path))
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "decisions"))


def test_days_restarts_and_late_rows(spark, tmp_path):
    write(spark, [(i, at(1, 100 + i), "reserve", None, None) for i in range(3)] + [(9, at(2, 0), "reserve", None, None), (10, None, "reserve", None, None)], str(tmp_path / "in"))
    first = go(spark, tmp_path)
    assert sorted((r.day, r.accepted, r.spent) for r in first.filter("NOT closed").collect()) == [("2024-01-01", True, 0.03), ("2024-01-01", True, 0.06), ("2024-01-01", True, 0.09), ("2024-01-02", True, 0.03)]
    # A second run goes on with the counters of the checkpoint.
    write(spark, [(20, at(1, 86_300), "reserve", None, None), (21, at(1, 86_301), "reserve", None, None), (22, at(2, 86_000), "reconcile", 600.0, None)], str(tmp_path / "in"))
    second = {(r.day, r.ts): (r.accepted, r.spent) for r in go(spark, tmp_path).filter("NOT closed").collect()}
    # The watermark stood at midnight less ten minutes: the first day was still open for its last rows.
    assert second["2024-01-01", at(1, 86_300)] == (True, 0.12) and second["2024-01-01", at(1, 86_301)] == (False, 0.12)
    assert second["2024-01-02", at(2, 86_000)] == (True, 0.06)
    # The third run's watermark is in the third day: both days are closed, their late rows are dropped.
    write(spark, [(30, at(3, 50_000), "reserve", None, None)], str(tmp_path / "in"))
    go(spark, tmp_path)
    write(spark, [(40, at(1, 600), "reserve", None, None), (41, at(3, 50_001), "refund", None, None)], str(tmp_path / "in"))
    last = go(spark, tmp_path)
    closed = {r.day: (r.spent, r.n_accepted, r.n_denied) for r in last.filter("closed").collect()}
    assert closed["2024-01-01"] == (0.12, 4, 1) and closed["2024-01-02"] == (0.06, 1, 0)
    assert last.filter("ts = timestamp'2024-01-01 00:10:00'").count() == 0
    assert {r.spent for r in last.filter("kind = 'refund'").collect()} == {0.0}


def test_stream_gives_what_the_fold_gives(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, at(rng.randrange(1, 5), rng.randrange(86_400)), rng.choice(["reserve", "reserve", "reconcile", "refund"]), rng.choice([15.0, 600.0, None]), None) for i in range(200)]
    write(spark, rows, str(tmp_path / "in"))
    out = go(spark, tmp_path, 0.3).filter("NOT closed").groupBy("day").agg(F.max("n_accepted").alias("accepted"), F.max("n_denied").alias("denied"))
    priced = spark.createDataFrame([(r[1], r[2], budgets.cost(r[3], r[4])) for r in rows], "ts timestamp, kind string, cost double")
    assert sorted(map(tuple, out.collect())) == sorted((r.day, r.accepted, r.denied) for r in streams.budget(priced, 0.3).collect())
