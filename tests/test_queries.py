"""Every registered query against its SQL twin."""

import math
import os

import pytest

import __spark_entry__ as entry_points
from tidewarden.plans.catalog import QUERIES
from tidewarden.plans.oracles import oracle_sql

SF_DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{file}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "<null>"
    return str(int(value)) if isinstance(value, float) and value == int(value) else str(value)


def test_every_query_has_a_twin():
    assert QUERIES.keys() == oracle_sql().keys()
    assert QUERIES.items() <= entry_points.queries().items()
    assert entry_points.oracle_sql().keys() <= entry_points.queries().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = entry_points.queries()[name](spark, SF_DIR)
    want = duck.execute(entry_points.oracle_sql()[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert columns == sorted(names)
    want_rows = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in got.select(*columns).collect()) == want_rows


def test_flagship(spark):
    assert entry_points.entry(spark).count() > 0
