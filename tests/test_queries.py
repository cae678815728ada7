"""Every registered query against its DuckDB twin on the smallest tables."""

import math
import os

import pytest

from locusframe import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not there")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    place = [names.index(c) for c in sorted(names)]
    expected = [tuple(r[k] for k in place) for r in result.fetchall()]
    key = repr
    assert sorted((tuple(map(plain, r)) for r in rows), key=key) == sorted((tuple(map(plain, r)) for r in expected), key=key)
