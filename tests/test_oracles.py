"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from sparkrecall import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)

    def text(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "-"
        if isinstance(v, float):  # a column of whole numbers that has nulls comes as float from one side
            return str(int(v)) if v.is_integer() else repr(v)
        return str(v)

    return sorted(tuple(text(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, DATA).toPandas()
    if name in Q.SQL:
        expected = duck.execute(Q.SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)
