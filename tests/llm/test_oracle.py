"""Operators whose whole result SQL can tell, against DuckDB."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from atlasframe.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    rows = queries()[name](spark, DATA)
    found = con.sql(oracle_sql()[name])
    assert sorted(found.columns) == sorted(rows.columns)
    at = [found.columns.index(c) for c in rows.columns]
    assert sorted(map(tuple, rows.collect())) == sorted(tuple(r[i] for i in at) for r in found.fetchall())
