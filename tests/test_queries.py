"""Every registered query of the graph engine against DuckDB on the same tables."""

import os

import duckdb
import pytest

from weftline.plans.queries import REGISTERED
from weftline.plans.tables import Tables


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return Tables(spark, sf_dir)


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_against_sql(name, tables, duck):
    query, sql = REGISTERED[name]
    df = query(tables)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    assert sql is not None
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({sql}) q").fetchall()
    assert got == sorted(repr(tuple(map(plain, r))) for r in want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "PythonRDD" not in plan


def test_plans(tables):
    """Texts are read once, lines meet by stretches, and filters and columns reach the scan."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scores = plan(REGISTERED["doc01_bm25"][0](tables))
    assert "text:string" not in scores and "documents.parquet" not in scores
    assert "_lines" in plan(REGISTERED["join07_enclosing_symbol"][0](tables))
    reach = plan(REGISTERED["gra01_impact"][0](tables))
    assert "lineitem.parquet" not in reach and "SortMergeJoin [target_type" not in reach
    one = plan(tables.customer.where("c_custkey = 7").select("c_name"))
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,7)]" in one and "ReadSchema: struct<c_custkey:bigint,c_name:string>" in one
