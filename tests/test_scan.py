"""Positional operators: interpolation, runs, forward fill, lag, rolling."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from envseries.operators import scan, timeline

FIX = [None, 1, None, None, None, None, None, 7, None, 9, None, None, None, None]
LIMIT3 = [None, 1, 2, 3, 4, None, None, 7, 8, 9, 9, 9, 9, None]
SHORT3 = [None, 1, None, None, None, None, None, 7, 8, 9, None, None, None, None]


def _series(spark, vals, step_hours=12, keys=("a",)):
    rows = []
    for k in keys:
        for i, v in enumerate(vals):
            rows.append((k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=step_hours * i),
                         None if v is None else float(v)))
    return spark.createDataFrame(rows, "s string, ts timestamp_ntz, x double")


def _vals(df, key="a"):
    return [r.x for r in df.filter(F.col("s") == key).orderBy("ts").collect()]


@pytest.mark.parametrize("bucket", ["day", "month", "year"])
def test_interpolate_limit_matches_fixture(spark, bucket):
    df = _series(spark, FIX, keys=("a", "b"))
    out = scan.interpolate(df, ["s"], "ts", ["x"], limit=3, mode="limit", bucket=bucket)
    assert _vals(out, "a") == LIMIT3
    assert _vals(out, "b") == LIMIT3


def test_interpolate_short_gaps(spark):
    out = scan.interpolate(_series(spark, FIX), ["s"], "ts", ["x"], limit=3, mode="short_gaps", bucket="day")
    assert _vals(out) == SHORT3


def test_interpolate_without_series_key(spark):
    df = _series(spark, FIX).drop("s")
    out = scan.interpolate(df, [], "ts", ["x"], limit=3, bucket="day")
    assert [r.x for r in out.orderBy("ts").collect()] == LIMIT3


def test_interpolate_independent_of_partitioning(spark):
    df = _series(spark, FIX, keys=("a", "b", "c"))
    base = sorted(scan.interpolate(df, ["s"], "ts", ["x"], bucket="day").collect())
    shuffled = df.repartition(7).orderBy(F.rand(3))
    assert sorted(scan.interpolate(shuffled, ["s"], "ts", ["x"], bucket="day").collect()) == base


def test_max_null_run(spark):
    flags = [0, 1, 1, 0, 1, 1, 1, 0]
    vals = [1.0 if f == 0 else None for f in flags]
    out = scan.null_runs(_series(spark, vals), ["s"], "ts", ["x"], bucket="day").collect()
    assert out[0].max_run == 3


def test_null_runs_zero_and_all_null(spark):
    full = scan.null_runs(_series(spark, [1, 2, 3]), ["s"], "ts", ["x"], bucket="day").first()
    assert full.max_run == 0
    empty = scan.null_runs(_series(spark, [None] * 5), ["s"], "ts", ["x"], bucket="day").first()
    assert empty.max_run == 5


def test_forward_fill_and_limit(spark):
    df = _series(spark, FIX)
    assert _vals(scan.forward_fill(df, ["s"], "ts", ["x"], bucket="day")) == \
        [None, 1, 1, 1, 1, 1, 1, 7, 7, 9, 9, 9, 9, 9]
    assert _vals(scan.forward_fill(df, ["s"], "ts", ["x"], limit=2, bucket="day")) == \
        [None, 1, 1, 1, None, None, None, 7, 7, 9, 9, 9, None, None]


def test_lag_rows_crosses_buckets(spark):
    df = _series(spark, list(range(10)))
    out = scan.lag_rows(df, ["s"], "ts", "x", 3, bucket="day").orderBy("ts").collect()
    assert [r.x_lag3 for r in out] == [None, None, None, 0, 1, 2, 3, 4, 5, 6]


def test_rolling_centered_min_periods(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(i + 1)) for i in range(8)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    out = timeline.rolling_centered(df, "v", unit="day", window=7, min_periods=4).orderBy("ts").collect()
    assert [r.rolling for r in out] == [2.5, 3, 3.5, 4, 5, 5.5, 6, 6.5]


def test_empty_day_aggregates(spark):
    rows = [(dt.datetime(2024, 1, 1, 5), 1.0), (dt.datetime(2024, 1, 1, 6), 3.0), (dt.datetime(2024, 1, 3, 1), 5.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    out = timeline.resample(df, {"s": F.sum("v"), "m": F.avg("v"), "md": F.median("v")}, unit="day",
                            zero_fill=["s"]).orderBy("ts").collect()
    assert len(out) == 3
    empty = out[1]
    assert (empty.s, empty.m, empty.md) == (0.0, None, None)


def test_missing_periods_and_completeness(spark):
    hours = [0, 1, 2, 5, 6]
    rows = [(dt.datetime(2024, 1, 1, h),) for h in hours] + [(dt.datetime(2024, 1, 1, 2, 30),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    missing = sorted(r.ts.hour for r in timeline.missing_periods(df, [], "ts", "hour").collect())
    assert missing == [3, 4]
    c = timeline.completeness(df, [], "ts", "hour").first()
    assert (c.n_present, c.n_expected, c.n_rows) == (5, 7, 6)
    assert c.completeness_pct == pytest.approx(500 / 7)
    assert c.row_completeness_pct == pytest.approx(600 / 7)
