import importlib

import pytest
from oracle import check_same

from normcast.plans import catalog, oracles

SQL = oracles.oracle_sql()
QUERIES = catalog.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    check_same(QUERIES[name](spark, small), small, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_and_registry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 3
    assert set(SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
