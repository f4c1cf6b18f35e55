"""Every registered query of the engine against its oracle at sf0.001, and on a session with empty defaults."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as E
from equiflow.plans import registry
from tests.conftest import SF_SMALL
from tests.oracle import assert_equal, connect

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)
    assert set(E.oracle_sql()) <= set(E.queries()) and set(QUERIES) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["ticker", "metric", "value"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, con, name):
    assert_equal(QUERIES[name](spark, SF_SMALL), con, ORACLE[name])


def test_queries_run_on_a_session_with_empty_defaults(tmp_path):
    """No setting of the container: neither spark-defaults nor a checkpoint folder."""
    (tmp_path / "conf").mkdir()
    code = """
import __spark_entry__ as E
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
s.sparkContext.setCheckpointDir("chosen")
before = s.sparkContext.getCheckpointDir()
assert s.conf.get("spark.checkpoint.dir", None) is None
for name in ("latest_period", "dcf_summary", "sink_roundtrip", "event_sessions", "csv_roundtrip"):
    assert E.queries()[name](s, "%s").count() > 0, name
assert s.sparkContext.getCheckpointDir() == before
""" % SF_SMALL
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": root}
    run = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
