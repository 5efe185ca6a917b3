"""Every registered query against its SQL over the smallest tables."""

import pytest

import __spark_entry__ as entry
from saffron.registry import ORACLE_SQL, QUERIES
from tests.conftest import SMALL, same_as_duckdb


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same_as_duckdb(QUERIES[name](spark, SMALL), ORACLE_SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_without_sql_repeat_themselves(spark, name):
    first, second = (sorted(map(str, QUERIES[name](spark, SMALL).collect())) for _ in range(2))
    assert first and first == second


def test_the_driver_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "book_id", "title", "author", "name"]
