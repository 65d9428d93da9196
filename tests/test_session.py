"""Session handling: the cluster's checkpoint folder is read, never replaced."""

import os
import subprocess
import sys
import tempfile

from envseries.session import checkpoint_dir, configure, materialize

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_configure_keeps_checkpoint_dir_and_pins_utc(spark):
    before = checkpoint_dir(spark)
    assert before  # set by the cluster defaults or, when unset, by local_session
    configure(spark)
    assert checkpoint_dir(spark) == before
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_materialize_is_a_reliable_checkpoint(spark):
    df = spark.range(10).selectExpr("id", "id * 2 AS twice")
    m = materialize(df)
    assert m.count() == 10
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan  # lineage cut: reads the checkpoint, not the source


def test_without_a_configured_folder():
    """An empty Spark configuration: queries configure the session; only a checkpoint asks for the folder."""
    code = """
from pyspark.sql import SparkSession
from envseries.session import configure, local_session, materialize
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()
df = configure(spark).range(3)
assert df.count() == 3
try:
    materialize(df)
except ValueError as e:
    assert 'spark.checkpoint.dir' in str(e)
else:
    raise AssertionError('no folder, no error')
spark.stop()
spark = local_session(1)
assert materialize(spark.range(3)).count() == 3
spark.stop()
"""
    env = os.environ | {"SPARK_CONF_DIR": tempfile.mkdtemp(prefix="envseries-conf-"), "PYTHONPATH": ROOT}
    subprocess.run([sys.executable, "-c", code], env=env, check=True, timeout=300)
