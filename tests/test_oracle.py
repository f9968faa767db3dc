"""Every registered query against its SQL on the smallest tables."""
import os

import pytest

from tenetdq.suite import ORACLES, QUERIES
from tenetdq.suite.check import compare

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
SAMPLE = ["normalize_values", "column_profile", "mine_fds", "mine_fds_composite", "score_table", "rank01",
          "routed_score", "order_dc_monitor", "contract_summary", "repair_apply", "lossless_reconstruction",
          "isotonic_residual", "linear_fit", "evaluate_detection", "stream_score", "csv_source"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert {q for q in QUERIES if q not in ORACLES} == {"routed_score_linear", "gated_score"}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("CHECK_ALL") else SAMPLE)
def test_query_matches_sql(spark, name):
    ok, message, _ = compare(spark, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert ok, message
