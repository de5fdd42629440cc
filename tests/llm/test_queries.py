"""Queries with SQL against it, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from sparkrecall.llm import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    expected = con.execute(Q.SQL[name])
    columns = [c[0] for c in expected.description]
    got = Q.QUERIES[name](spark, DATA).select(*columns).collect()
    assert got and sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected.fetchall()))
