"""Every registered query against its DuckDB oracle on the smallest tables.

Same comparison as the driver: column names, row count and the multiset
of rows (floats rounded).  Queries without an SQL oracle must still run
and return a stable schema.
"""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    if name in ORACLES:
        assert r["ok"], r
    else:
        assert r["rows"] > 0


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == E.entry(spark).columns
    assert df.count() >= 0
