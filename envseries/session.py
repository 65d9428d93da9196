"""Session helpers.

The library never builds its own cluster session inside operators; callers
pass a ``SparkSession``.  ``configure`` only pins settings the operators rely
on (UTC session zone).  The checkpoint folder is the cluster's to name, in
``spark.checkpoint.dir``; only ``local_session`` picks one where it is unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the session settings the operators assume.

    * session time zone UTC: timestamps are true instants, local wall-clock
      features are derived explicitly (``functions.timecols.local_time``);
    * AQE on (coalescing, skew-join splitting);
    * ``spark.checkpoint.dir``, where set, as the folder of reliable checkpoints.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    configured = checkpoint_dir(spark)
    if configured and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(configured)
    return spark


def materialize(df):
    """Cut the lineage of a frame that several branches read.

    A reliable checkpoint into the cluster's shared ``spark.checkpoint.dir``
    (never a local checkpoint): lost executors re-read it instead of
    recomputing the whole upstream plan.
    """
    required_checkpoint_dir(configure(df.sparkSession))
    return df.checkpoint(eager=True)


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the cluster, if any."""
    value = spark.conf.get("spark.checkpoint.dir", None)
    if not value:
        value = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return value or None


def required_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, or an error that says how to name one."""
    value = checkpoint_dir(spark)
    if not value:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share; "
                         "set it when the session is built")
    return value


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "envseries") -> SparkSession:
    """A local session for tests and the benchmark (not for clusters)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ENVSERIES_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    if not checkpoint_dir(spark):  # a static setting: it can only be given when the session is built
        spark.stop()
        spark = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="envseries-ckpt-")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
