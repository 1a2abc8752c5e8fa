"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from harrow.plans import catalog
from harrow.plans.views import BASE

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in BASE:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def shown(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: round(float(v), 6) + 0.0 if type(v).__name__ in ("float", "Decimal") else v
    return sorted(repr([cell(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got.columns, got.collect()) == shown(want.columns, want.fetchall())
