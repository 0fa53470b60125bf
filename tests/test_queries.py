"""Every registered query of the library's own operators against its SQL."""

import glob
import os

import duckdb
import pytest

from scriptorium.oracles import ORACLES
from scriptorium.queries import QUERIES


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, small, tables, name):
    got, want = QUERIES[name](spark, small), tables.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = lambda found: sorted(map(repr, found))
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(want.fetchall())
