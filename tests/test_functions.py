"""Column functions: bins, sectors, flags, time zones, parsing."""

import datetime as dt

from pyspark.sql import functions as F

from envseries.functions import bins
from envseries.functions.timecols import localize, parse_offset_ts, weekday0


def test_right_closed_bins(spark):
    vals = [0.0, 5.0, 5.1, 300.0, 301.0, -1.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out = [r.c for r in df.select(bins.right_closed_bins("x", bins.WIND_EDGES, bins.WIND_LABELS).alias("c"))
           .collect()]
    assert out == [None, "Windstill", "Leicht", "Stark", None, None]


def test_right_closed_bins_include_lowest(spark):
    df = spark.createDataFrame([(0.0,)], "x double")
    r = df.select(bins.right_closed_bins("x", bins.WIND_EDGES, bins.WIND_LABELS, include_lowest=True)
                  .alias("c")).first()
    assert r.c == "Windstill"


def test_sectors(spark):
    vals = [0.0, 22.5, 22.6, 359.9, -10.0, 720.0]
    df = spark.createDataFrame([(v,) for v in vals], "d double")
    out = [r.s for r in df.select(bins.sector("d").alias("s")).collect()]
    assert out == [0, 0, 1, 15, 15, 0]
    assert df.select(F.pmod(F.lit(-10.0), F.lit(360.0)).alias("m")).first().m == 350.0


def test_flag_null_is_zero(spark):
    df = spark.createDataFrame([(None,), (0.05,), (0.2,)], "p double")
    out = [r.f for r in df.select(bins.flag(F.col("p") > 0.1).alias("f")).collect()]
    assert out == [0, 0, 1]


def test_weekday_monday_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 7),)], "ts timestamp_ntz")
    assert [r.w for r in df.select(weekday0("ts").alias("w")).collect()] == [0, 6]


def test_offset_timestamp_to_utc(spark):
    df = spark.createDataFrame([("2023-01-01T00:00+0100",)], "s string")
    assert df.select(parse_offset_ts("s").alias("t")).first().t == dt.datetime(2022, 12, 31, 23, 0)


def test_localize_dst_rules(spark):
    wall = [dt.datetime(2023, 1, 1) + dt.timedelta(hours=i) for i in range(8760)]
    df = spark.createDataFrame([(w,) for w in wall], "w timestamp_ntz")
    out = df.select("w", localize("w", "Europe/Zurich").alias("u"))
    # autumn fall-back hour is ambiguous -> null
    amb = out.filter(F.col("w") == dt.datetime(2023, 10, 29, 2)).first()
    assert amb.u is None
    # spring gap shifts to the transition instant (03:00 local = 01:00 UTC)
    gap = out.filter(F.col("w") == dt.datetime(2023, 3, 26, 2)).first()
    assert gap.u == dt.datetime(2023, 3, 26, 1)
    # winter: UTC+1
    assert out.filter(F.col("w") == dt.datetime(2023, 1, 1, 0)).first().u == dt.datetime(2022, 12, 31, 23)
    n_null = out.filter(F.col("u").isNull()).count()
    n_distinct = out.filter(F.col("u").isNotNull()).select("u").distinct().count()
    assert (n_null, n_distinct) == (1, 8758)


def test_join_on_true_instants_is_unique(spark):
    a = spark.range(8760).select(F.timestamp_seconds(F.lit(1672527600) + F.col("id") * 3600)
                                 .cast("timestamp_ntz").alias("ts"))
    b = spark.range(8760).select(F.timestamp_seconds(F.lit(1672531200) + F.col("id") * 3600)
                                 .cast("timestamp_ntz").alias("ts"))
    j = a.join(b, "ts")
    assert j.count() == 8759 and j.select("ts").distinct().count() == 8759


def test_units_and_limits_by_column_name(spark):
    from envseries.functions.units import limits_of, unit_of
    from envseries.operators import profile
    assert [unit_of(c) for c in ("no2", "no", "pm25_std", "wind_direction_10m", "precipitation", "other")] == [
        "µg/m³", "µg/m³", "µg/m³", "°", "mm/h", ""]
    assert limits_of(["no", "no2", "pm10", "pm25", "o3", "cloud_cover"]) == {"no2": 40.0, "pm10": 45.0, "pm25": 15.0, "o3": 100.0}
    df = spark.createDataFrame([(41.0, 1.0), (40.0, None), (None, 2.0)], "no2 double, no double")
    out = profile.limit_exceedance(df).collect()
    assert [(r.column, r.limit_value, r.n_exceed, r.exceed_pct) for r in out] == [("no2", 40.0, 1, 50.0)]
