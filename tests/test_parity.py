"""Every registered query against its SQL, and rows for those without SQL."""

import pytest

import __spark_entry__ as entry
from parity import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


MAY_BE_EMPTY = {"ba_num_cat_summary"}  # its groups need more rows than this scale factor has


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - MAY_BE_EMPTY))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["column"] for r in rows} == set(entry.MEASURES)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
