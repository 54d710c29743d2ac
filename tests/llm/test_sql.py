"""The queries that have SQL against it, in DuckDB on the same tables."""

import os

import duckdb
import pytest

from weftline.llm import queries


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]}) q").fetchall()
    assert got == sorted(repr(tuple(map(plain, r))) for r in want)
