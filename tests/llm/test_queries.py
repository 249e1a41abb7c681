"""The pN_ queries on the smallest tables, against SQL where there is one."""

from __future__ import annotations

import pytest

from skarn.llm import queries
from tests.compare import DATA, compare, connect

FOLDER = str(DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    if name in queries.SQL:
        mine, theirs, only_mine, only_theirs = compare(df, queries.SQL[name], connect(FOLDER))
        assert (mine, only_mine, only_theirs) == (theirs, [], [])
    else:
        assert df.count() >= 0


def test_columns(spark):
    want = {
        "p1_found": ["module", "category", "difficulty"], "p2_found": ["table_name", "row_key"], "p3_found": ["record_id", "group_id"], "p4_found": ["result_id", "defect"],
        "p5_found": ["id_a", "id_b"], "p6_found": ["table_name", "row_no", "kind"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id_a", "doc_id_b"],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, FOLDER).columns == columns
