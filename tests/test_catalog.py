"""Every query against its SQL at the smallest scale."""

import math
import os

import pytest

from textloom import catalog

Q, SQL = catalog.queries(), catalog.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def compare(df, sql, sf):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    want = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    compare(Q[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("name", sorted(Q.keys() - SQL.keys() - {"knn_lsh"}))
def test_runs(spark, sf, name):
    assert Q[name](spark, sf).count() > 0


def test_clean_to_raw_crosses_the_network_once(spark, sf, tmp_path):
    plan = Q["clean_to_raw"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    rows = [("a", "\tc"), ("a\t", "c"), (None, "c"), (None, "c"), ("a", "b"), ("a", "b"), ("a", " ")]
    spark.createDataFrame(rows, "lang string, text string").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    compare(Q["clean_to_raw"](spark, str(tmp_path)), SQL["clean_to_raw"], str(tmp_path))


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 100
    assert set(e.oracle_sql()) <= set(e.queries())
