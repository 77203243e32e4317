"""Registered queries against their SQL, on the smallest driver tables."""

import pytest

from __spark_entry__ import entry
from tests.check_queries import connect, difference, spark_rows, sql_rows
from workload import registered


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(n for n, q in registered().items() if q.sql))
def test_query(spark, con, sf_dir, name):
    query = registered()[name]
    assert difference(spark_rows(query.run(spark, sf_dir)), sql_rows(con, query.sql)) is None


def test_entry(spark):
    assert entry(spark).count() == 1
