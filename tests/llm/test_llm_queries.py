"""The package's queries run, and equal their SQL where they have it."""

import pytest
from oracle import compare, connect

from skylattice.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        compare(df, connect(data), ORACLES[name])
    else:
        assert df.count() >= 0


def test_result_columns(spark, data):
    want = {"p3_found": ["area"], "p5_found": ["msg_a", "msg_b"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "sent_start", "sent_end"]}
    for name, columns in want.items():
        assert QUERIES[name](spark, data).columns == columns
