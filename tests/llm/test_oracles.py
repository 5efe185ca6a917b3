import pytest

from saffron.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SMALL, same_as_duckdb


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same_as_duckdb(QUERIES[name](spark, SMALL), ORACLE_SQL[name], SMALL)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
