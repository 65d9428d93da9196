"""Cleaning and feature operators: dedupe, bounds, winsorising, scaling."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from envseries.operators import cleaning, features


def test_dedupe_keep_first_is_deterministic(spark):
    rows = [("k", dt.datetime(2024, 1, 1), 5.0), ("k", dt.datetime(2024, 1, 1), 2.0),
            ("j", dt.datetime(2024, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz, v double")
    for parts in (1, 8):
        shuffled = df.repartition(parts).orderBy(F.rand(parts))
        out = {r.s: r.v for r in cleaning.dedupe_first(shuffled, ["s", "ts"]).collect()}
        assert out == {"k": 2.0, "j": 1.0}


def test_dedupe_matches_window_variant(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rest = [c for c in li.columns if c not in ("l_orderkey", "l_linenumber")]
    a = cleaning.dedupe_first(li, ["l_orderkey", "l_linenumber"])
    b = cleaning.row_first_keep_window(li, ["l_orderkey", "l_linenumber"], rest).select(*li.columns)
    assert a.count() == li.select("l_orderkey", "l_linenumber").distinct().count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_bounds_substring_rules(spark):
    df = spark.createDataFrame([(600.0, 350.0, 5.0)], "NO double, NO2 double, O3 double")
    out = cleaning.bounds_to_null(df, cleaning.POLLUTANT_BOUNDS, substring=True).first()
    assert out.NO is None and out.NO2 is None and out.O3 == 5.0
    exact = cleaning.bounds_to_null(df, {"NO": (0, 500)}).first()
    assert exact.NO is None and exact.NO2 == 350.0


def test_winsorize_trigger(spark):
    rng = np.random.default_rng(1)
    big = spark.createDataFrame([(float(x),) for x in rng.permutation(1000)], "v double")
    assert sorted(r.v for r in cleaning.winsorize(big, ["v"]).collect()) == list(map(float, range(1000)))
    small = spark.createDataFrame([(float(x),) for x in rng.permutation(66)], "v double")
    w = [r.v for r in cleaning.winsorize(small, ["v"]).collect()]
    assert sum(1 for a, b in zip(sorted(w), range(66)) if a != b) == 2
    forced = [r.v for r in cleaning.winsorize(spark.createDataFrame([(float(x),) for x in range(10)], "v double"),
                                              ["v"], threshold_pct=0.0).collect()]
    assert min(forced) > 0 and max(forced) < 9


def test_missing_flags_only_columns_with_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    out = cleaning.missing_flags(df, ["a", "b"])
    assert "a_missing" not in out.columns and [r.b_missing for r in out.collect()] == [1, 0]


def test_scaling_constant_and_null(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, None), (5.0, 3.0)], "c double, x double")
    out = features.scale(df, ["c", "x"]).collect()
    assert all(r.c_std == 0.0 and r.c_norm == 0.0 for r in out)
    xs = np.array([1.0, 0.0, 3.0])
    np.testing.assert_allclose([r.x_std for r in out], (xs - xs.mean()) / xs.std(), rtol=1e-12)
    assert [r.x_norm for r in out] == [1 / 3, 0.0, 1.0]


def test_condition_flags_null_is_zero(spark):
    df = spark.createDataFrame([(None, None, 1000.0), (0.5, -5.0, 1050.0), (0.0, 20.0, None)],
                               "p double, t double, pr double")
    out = features.rain_flag(df, "p")
    out = features.joint_extreme_flag(out, "pr", "t")
    rows = out.collect()
    assert [r.rain for r in rows] == [0, 1, 0]
    assert all(r.inversion in (0, 1) for r in rows)
    assert rows[2].inversion == 0


def test_calendar_features(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 6, 8),), (dt.datetime(2024, 7, 3, 12),)], "ts timestamp_ntz")
    r = features.calendar_features(df, "ts").orderBy("ts").collect()
    assert (r[0].hour, r[0].weekday, r[0].month, r[0].season, r[0].is_weekend, r[0].is_rush_hour) == \
        (8, 5, 1, "Winter", 1, 1)
    assert (r[1].season, r[1].is_weekend, r[1].is_rush_hour) == ("Sommer", 0, 0)


def test_missingness_classes(spark):
    rows = []
    start = dt.datetime(2023, 1, 1)
    for i in range(24 * 365):
        t = start + dt.timedelta(hours=i)
        v = None if (t.month == 7 and t.day <= 10) else 1.0      # one long summer outage
        w = None if i % 97 == 0 else 2.0                         # sparse random-ish gaps
        rows.append((t, v, w))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double, w double")
    k4 = {r.column: r for r in cleaning.missingness_class(df, ["v", "w"], bucket="month").collect()}
    assert k4["v"].max_run == 240 and k4["v"].missing_class == "MAR"
    assert k4["w"].max_run == 1 and k4["w"].missing_class == "MCAR"
    k5 = {r.column: r for r in cleaning.missingness_class_matrix(df, ["v", "w"]).collect()}
    assert k5["v"].missing_class == "MAR" and k5["v"].active_months == "7"
    assert k5["w"].missing_class == "MCAR"
