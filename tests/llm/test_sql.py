"""Operators with SQL against it."""

import glob
import os

import duckdb
import pytest

from scriptorium import llm


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_operator_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got, want = llm.QUERIES[name](spark, small), con.execute(llm.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    plain = lambda found: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in found)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want.fetchall())
