"""Every registered query with an SQL twin gives the twin's rows, names, types and values."""

import pytest

import __spark_entry__ as e
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"
TWINS = e._case_oracle()
QUERIES = e._case_queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(TWINS))
def test_same_as_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, TWINS[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).collect()


def test_entry(spark):
    assert e.entry(spark).take(1)


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)
