"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from wayfold.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = lambda v: format(round(v, 6) + 0.0, ".6f") if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    rows = _rows(got.columns, got.collect())
    assert rows
    if name in queries.ORACLES:
        want = duck.sql(queries.ORACLES[name])
        assert sorted(want.columns) == sorted(got.columns)
        assert _rows(want.columns, want.fetchall()) == rows
