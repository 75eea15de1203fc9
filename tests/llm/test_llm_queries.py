"""Queries of the training-data operators on the smallest tables, against SQL where there is one."""

import os

import pytest

from loomline.llm import queries
from tests.oracle import differences

ROOT = os.environ.get("LOOMLINE_TEST_DATA", "/root/testdata/sf0.001")
SQL = queries.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")

COLUMNS = {
    "p1_found": ["src_table", "first_id", "copy_id"], "p2_found": ["src_table", "row_id", "kind"], "p3_found": ["turn_id"], "p4_found": ["session_id"], "p5_found": ["group_id", "field_name", "record_id"],
    "p6_found": ["doc_id"], "p7_found": ["source"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    q = queries.queries()[name]
    if name in SQL:
        assert differences(spark, ROOT, q, SQL[name]) == ""
        return
    df = q(spark, ROOT)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(rows) == len(set(rows))
