"""Every registered query of the library's own operators against its SQL in DuckDB, on the smallest tables."""

import decimal
import os

import pytest

from graphlens.plans import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 5) if isinstance(v, float) else round(float(v), 5) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    by = sorted(got.columns)
    mine = sorted(str([plain(r[c]) for c in by]) for r in got.collect())
    at = [want.columns.index(c) for c in by]
    assert mine == sorted(str([plain(r[k]) for k in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
