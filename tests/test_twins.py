"""Every registered query with a SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import duck, mismatch
from tests.conftest import SMALL

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, name):
    assert mismatch(QUERIES[name](spark, SMALL), con, SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["city_name", "year", "longest_severe_streak"]
