"""Queries with SQL give the rows the SQL gives; the others run and have the columns that are fixed for them."""

import pytest

from helpers import assert_same, connect
from tidemark.llm.oracle import ORACLE
from tidemark.llm.queries import QUERIES

COLUMNS = {
    "p1_found": ["tbl", "row_id"],
    "p2_found": ["field_name", "term", "mark"],
    "p4_found": ["name_a", "name_b"],
    "p5_found": ["query_id", "doc_id"],
    "p6_found": ["news_id", "term"],
    "p7_found": ["doc_a", "doc_b"],
    "p8_found": ["doc_id"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id", "start_pos", "end_pos"],
}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, small, con, name):
    assert_same(spark, con, small, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, small, name):
    rows = QUERIES[name](spark, small)
    assert rows.columns == COLUMNS.get(name, rows.columns)
    assert rows.count() == rows.distinct().count() > 0
