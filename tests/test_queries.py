"""Every registered query with SQL beside it gives DuckDB's rows."""

import __spark_entry__
import compare
import pytest

QUERIES, ORACLE = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return compare.oracle(data)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, data, con, name):
    assert compare.differences(QUERIES[name](spark, data), con, ORACLE[name]) == ""
