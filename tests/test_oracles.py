"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from poseframe.catalog import FLAGSHIP, ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    res = duck.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(got.columns)
    want = sorted(tuple(map(plain, r)) for r in res.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got.collect()) == want
    assert want


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES
