"""Every training-data query with SQL gives DuckDB's rows."""

import os

import duckdb
import pytest

from ledgerframe.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in found.description)
    order = [[c[0] for c in found.description].index(c) for c in columns]
    df = queries.queries()[name](spark, DATA)
    assert sorted(df.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)
