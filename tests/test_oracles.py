"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from cuetrail import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def shown(v):
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    r = con.execute(catalog.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(shown(row[i]) for i in order) for row in r.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
