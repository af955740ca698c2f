import os

import pytest

from compare import SF, rows_of, rows_of_sql
from findling.llm.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
COLUMNS = {
    "p1_found": ["chunk", "file_id"], "p3_found": ["line_no", "mail_id"], "p4_found": ["file_a", "file_b"], "p5_found": ["file_id", "query_id"],
    "p6_found": ["basis", "file_a", "file_b"], "p7_found": ["field", "mail_id"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "form"],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_are_distinct_and_columns_as_stated(spark, name):
    df = QUERIES[name](spark, SF)
    if name in COLUMNS:
        cols, rows = rows_of(df)
        assert cols == COLUMNS[name] and len(rows) == len(set(rows))
    else:
        assert df.count() >= 0
