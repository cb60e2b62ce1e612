"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import pytest

from millrace.plans.registry import QUERIES, SQL
from tools.compare import connect, plain

SF = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("the benchmark tables are not here")
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(SQL[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(rel.fetchall(), rel.columns)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
