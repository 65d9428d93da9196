"""Intermediate tables and files in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import required_checkpoint_dir

#: Settings of the session while a table is written: shuffle files go at the end of the query, and Python workers get
#: record batches of bounded bytes (ten thousand long texts would be one batch else).
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
           "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; an error if the session names no such folder."""
    base = required_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/envseries/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors.

    The table stands for the job's shuffle files, so those go as soon as it is written; the session keeps its settings.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more; frames that still refer to them can't be used."""
    for df in frames:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if "/envseries/" not in folder:
                raise ValueError(f"not a table of the shared folder: {folder}")
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A written table of short keys, marked for a broadcast if it has no more than ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
