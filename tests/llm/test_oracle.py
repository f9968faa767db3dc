"""Every corpus query that has SQL, against it."""
import pytest

from tenetdq.llm.queries import ORACLES, QUERIES
from tenetdq.suite.check import compare


def test_each_operator_has_a_query():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    ok, message, _ = compare(spark, name, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001")
    assert ok, message
