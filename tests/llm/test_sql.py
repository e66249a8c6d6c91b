"""The queries that SQL can express, against that SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from sparkloom.llm import oracles, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    made = con.sql(oracles.oracle_sql()[name])
    df = queries.queries()[name](spark, DATA).select(*made.columns)
    assert sorted(map(tuple, df.collect())) == sorted(made.fetchall())
