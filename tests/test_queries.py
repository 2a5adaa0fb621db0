"""Every registered query against its SQL on the smallest tables, and the shape of the registry."""

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, con, sf, name):
    _, _, verdict = check.compare(spark, con, QUERIES[name], ORACLES[name], sf)
    assert verdict == "ok"


def test_entry(spark):
    assert entry(spark).count() == 24


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 100
