"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from atlasframe import estate_queries, flow_queries, model_queries, usage_queries  # noqa: F401
from atlasframe.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.4f}" if isinstance(v, float) else v.isoformat()[:19] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, name):
    rows = QUERIES[name](spark, DATA)
    columns = sorted(rows.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect())
    if name not in SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.sql(SQL[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
