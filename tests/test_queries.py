from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import canonical, connect
from tidemark.plans import all_queries

RUNS, SQL = all_queries()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = canonical(RUNS[name](spark, sf).toPandas()), canonical(duck.sql(SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(RUNS) - set(SQL)))
def test_other_queries_run(spark, sf, name):
    assert RUNS[name](spark, sf).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and rows[0].norm >= rows[-1].norm
    assert set(SQL) <= set(entry.oracle_sql()) and set(RUNS) <= set(entry.queries())
