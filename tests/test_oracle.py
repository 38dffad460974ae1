"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import SMALL, entry, oracle_sql, queries
from pointline.plans.catalog import QUERIES as OWN
from tests.compare import database, difference

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


def test_every_query_has_sql():
    """All of the library's own queries have one; of the text operators (tests/llm) those that SQL can express."""
    assert set(OWN) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_difference_sees_a_changed_value(spark, con):
    frame = spark.sql("SELECT 1L AS a, 'x' AS b")
    assert difference(frame, con, "SELECT 'x' AS b, CAST(1 AS BIGINT) AS a") == ""
    assert difference(frame, con, "SELECT 'x' AS b, CAST(2 AS BIGINT) AS a")
    assert difference(frame, con, "SELECT 'x' AS b, 1 AS a")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    assert difference(queries()[name](spark, SMALL), con, oracle_sql()[name]) == ""
