"""Every query runs on the smallest tables and agrees with its SQL."""

import os

import pytest

from loomline import oracle, queries
from tests.oracle import differences, sql_rows

ROOT = os.environ.get("LOOMLINE_TEST_DATA", "/root/testdata/sf0.001")
SQL = oracle.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    q = queries.queries()[name]
    if name in SQL:
        assert differences(spark, ROOT, q, SQL[name]) == ""
    else:
        assert q(spark, ROOT).count() > 0


def test_names_match():
    assert set(SQL) == set(queries.queries())


def test_harness_notices_a_difference(spark):
    bad = sql_rows(ROOT, "SELECT 1 AS a")
    assert bad[0] == ["a"]
    assert differences(spark, ROOT, lambda s, _: s.range(2).toDF("a"), "SELECT 1 AS a") != ""


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if ROOT.startswith("/root"):
        assert e.entry(spark).count() > 0
