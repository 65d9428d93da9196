"""Digests, sketches and counts that merge, and plans that read their input once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from envseries.operators import cleaning, profile, quality


@pytest.fixture(scope="module")
def table(spark):
    rows = [(dt.datetime(2023, 1 + i % 12, 1 + i % 28), ("a", "b", None)[i % 3], i % 7 / 3, i % 50) for i in range(600)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, s string, v double, k int").repartition(5)


def test_digests_of_parts_add_up_to_the_table(table):
    parts = quality.content_digest(table, {"month": F.month("ts"), "s": F.col("s")})
    assert parts.count() == 12
    whole = quality.content_digest(table).first()
    assert quality.merged_digests(parts).first() == whole and whole.n_rows == 600
    by_month = {r.month: r.digest for r in quality.merged_digests(parts, ["month"]).collect()}
    assert by_month == {r.month: r.digest for r in quality.content_digest(table, {"month": F.month("ts")}).collect()}
    # the order of rows and noise beyond the sixth decimal change nothing, a value does
    noisy = table.withColumn("v", F.col("v") + F.lit(1e-9)).orderBy("k")
    assert quality.content_digest(noisy).first() == whole
    assert quality.content_digest(table.withColumn("k", F.col("k") + (F.col("k") == 3).cast("int"))).first().digest != whole.digest


def test_changed_parts_names_them(table):
    parts = {"month": F.month("ts"), "s": F.col("s")}
    old = quality.content_digest(table, parts)
    new = table.filter("NOT (month(ts) = 2)").withColumn("v", F.when((F.month("ts") == 4) & F.col("s").isNull(), 99.0).otherwise(F.col("v")))
    new = new.unionByName(table.limit(1).select(F.lit(dt.datetime(2024, 1, 1)).alias("ts"), F.lit("new").alias("s"), "v", "k"))
    got = {(r.month, r.s): r.change for r in quality.changed_parts(old, quality.content_digest(new, parts), ["month", "s"]).collect()}
    keys = {(r.month, r.s) for r in old.collect()}
    want = {k: "removed" for k in keys if k[0] == 2} | {k: "changed" for k in keys if k == (4, None)} | {(1, "new"): "added"}
    assert got == want


def test_distinct_counts_without_expand_and_from_stored_sketches(spark, table, tmp_path):
    df = profile.column_profile(table, ["s", "v", "k"])
    assert {r.column: (r.n_distinct, r.n_non_null) for r in df.collect()} == {"s": (2, 400), "v": (7, 600), "k": (50, 600)}
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()
    profile.distinct_sketches(table.withColumn("m", F.month("ts")), ["k", "s"], ["m"]).write.parquet(str(tmp_path / "sketches"))
    stored = spark.read.parquet(str(tmp_path / "sketches"))
    assert {r.column: r.n_distinct for r in profile.distinct_estimates(stored).collect()} == {"k": 50, "s": 2}
    assert profile.distinct_estimates(stored, ["m"]).count() == 24


def test_join_quality_equals_the_join(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,), (4,)], "k int")
    right = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (5,)], "k int")
    r = quality.join_quality(left, right, ["k"]).first()
    assert (r.n_left, r.n_right, r.n_joined) == (5, 6, left.join(right, "k").count()) == (5, 6, 7)
    empty = quality.join_quality(left.limit(0), right.limit(0), ["k"]).first()
    assert (empty.n_left, empty.n_joined, empty.match_pct, empty.warn) == (0, 0, None, False)


def test_flags_come_from_the_run_that_writes_the_frame(spark, table):
    """What leads to the frame runs once, for the flags and for all later readers."""
    runs = spark.sparkContext.accumulator(0)

    def counted(rows):
        runs.add(1)
        return rows

    source = spark.createDataFrame(table.rdd.mapPartitions(counted), table.schema)
    out = cleaning.missing_flags(source.withColumn("v", F.when(F.col("k") != 3, F.col("v"))), ["v", "k"])
    assert out.columns == [*table.columns, "v_missing"]
    assert out.agg(F.sum("v_missing")).first()[0] == 12 and out.count() == 600
    assert runs.value == 5  # its five partitions, each once


def test_null_shares_and_warnings(spark, table):
    checks = spark.createDataFrame([("system", "time", 90.0, 95.0, False), ("content", "range", 1.0, 1.0, True)],
                                   "dimension string, check string, value double, threshold double, ok boolean")
    out = quality.quality_warnings(checks, quality.null_shares(table, ["s", "v"], "t"))
    assert {(r.check, r.severity): round(r.value, 3) for r in out.collect()} == {("time", "warn"): 90.0, ("null_share:t.s", "warn"): 33.333}
