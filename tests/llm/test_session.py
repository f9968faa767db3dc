"""Queries in a session that other work has used, and without the subpackage."""
import subprocess
import sys

from pyspark.sql import functions as F

from tenetdq.llm.queries import QUERIES
from tenetdq.session import settle_measured

SF = "/root/testdata/sf0.001"


def test_forest_runs_in_a_session_that_observed_a_query(spark):
    _, seen = settle_measured(spark.range(10).toDF("id"), rows=F.count(F.lit(1)))
    assert seen["rows"] == 10
    assert QUERIES["op1_secret_scan"](spark, SF).count() > 0


def test_the_entry_registers_the_rest_when_the_subpackage_cannot_be_imported():
    code = ("import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); "
            "assert 'mine_fds' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; e.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
