"""Every query runs on the smallest tables and, where it has SQL, gives the rows of DuckDB."""

import datetime
import decimal
import glob
import math
import os

import pytest

from textloom.plans import catalogue

SF = os.environ.get("TEXTLOOM_SF", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = [[plain(r[c]) for c in sorted(df.columns)] for r in df.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql:
        result = duck.execute(sql)
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        order = [columns.index(c) for c in sorted(columns)]
        assert sorted(map(repr, rows)) == sorted(repr([plain(r[k]) for k in order]) for r in result.fetchall())
