"""Sinks: partitioned table writes and small report outputs.

Everything is written by executors (``DataFrame.write``); the driver sees
counts.  Overwrites are atomic per job through Spark's commit protocol, so a
lost executor only re-runs its tasks.  A partitioned table is overwritten
partition by partition: those that the frame holds no row of stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = (),
                fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a table (default Parquet), optionally partitioned (e.g. by year).

    ``overwrite`` of a partitioned table replaces the partitions in ``df`` and
    leaves the others.
    """
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    w.save(path)


def with_year(df: DataFrame, ts: str) -> DataFrame:
    """Add the ``year`` partition column of a timestamp column."""
    return df.withColumn("year", F.year(ts))


def write_report(df: DataFrame, path: str) -> None:
    """A report table (quality checks, metrics, importances) as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_model_results(out_dir: str, metrics: DataFrame, importances: DataFrame) -> dict[str, str]:
    """Metrics per model and feature importances (A8) as CSV tables with a header; returns their paths."""
    paths = {"metrics": f"{out_dir}/model_metrics", "importances": f"{out_dir}/feature_importances"}
    for name, df in (("metrics", metrics), ("importances", importances)):
        write_table(df.coalesce(1), paths[name], fmt="csv")
    return paths


class Steps:
    """Tables and reports of a route below one folder, with a manifest of what each run has written.

    The manifest is a table (run, step, rows, partitions), appended to when a
    step is complete: rows are counted while they are written.  Without a
    ``run`` nothing counts as done.
    """

    SCHEMA = "run string, step string, n_rows long, partitions array<string>"

    def __init__(self, spark: SparkSession, out_dir: str, run: str | None = None):
        self.spark, self.out_dir, self.run = spark, out_dir.rstrip("/"), run

    def path(self, step: str) -> str:
        return f"{self.out_dir}/{step}"

    def manifest(self) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path("manifest"))
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).json(self.path("manifest"))

    def done(self, step: str) -> bool:
        if self.run is None:
            return False
        return not self.manifest().filter((F.col("run") == self.run) & (F.col("step") == step)).isEmpty()

    def _record(self, step: str, n_rows: int, partitions: list[str]) -> None:
        row = self.spark.createDataFrame([(self.run or "", step, n_rows, partitions)], self.SCHEMA)
        row.coalesce(1).write.mode("append").json(self.path("manifest"))

    def table(self, step: str, df: DataFrame, year: str | None = None) -> DataFrame:
        """Write ``df`` unless that is done, and read back what was written.

        With ``year`` (an int column) the table is partitioned by it, and of
        other runs' years nothing is read back.
        """
        if self.done(step):
            written = self.manifest().filter((F.col("run") == self.run) & (F.col("step") == step)).first()["partitions"]
        else:
            seen = Observation()
            # which years there are, a bit each, while they are written
            spans = [(lo, f"bit_or(CASE WHEN {year} BETWEEN {lo} AND {lo + 62} THEN shiftleft(1L, {year} - {lo}) END)")
                     for lo in range(1900, 2152, 63)] if year else []
            write_table(df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.expr(e).alias(f"y{lo}") for lo, e in spans]),
                        self.path(step), partition_by=[year] if year else [])
            written = [str(lo + i) for lo, _ in spans for i in range(63) if (seen.get[f"y{lo}"] or 0) >> i & 1]
            self._record(step, seen.get["n"], written)
        if not year:
            return self.spark.read.parquet(self.path(step))
        return self.spark.read.schema(df.schema).parquet(self.path(step)).filter(F.col(year).isin([int(y) for y in written]))

    def report(self, step: str, df: DataFrame) -> None:
        """Write a report as JSON lines unless that is done."""
        if not self.done(step):
            seen = Observation()
            write_report(df.observe(seen, F.count(F.lit(1)).alias("n")), self.path(step))
            self._record(step, seen.get["n"], [])
