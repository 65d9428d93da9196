"""End-to-end route on hand-made source files (CSV with BOM + nested JSON feed)."""

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from envseries.operators.cleaning import POLLUTANT_BOUNDS, WEATHER_BOUNDS
from envseries.plans import flow

POLL = ["NO", "NO2", "PM2.5"]
WX = ["temperature_2m", "precipitation", "surface_pressure", "wind_speed_10m"]


def _files(d, hours=72):
    start = dt.datetime(2023, 1, 1)   # local +01:00 wall clock in the CSV
    with open(os.path.join(d, "air.csv"), "w", encoding="utf-8-sig") as f:
        f.write("Datum,Parameter,Wert,Standort\n")
        for h in range(hours):
            t = (start + dt.timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M+0100")
            for i, p in enumerate(POLL):
                if h == 10 and p == "NO":
                    continue                      # a gap to interpolate
                v = 600.0 if (h == 20 and p == "NO2") else 10 + i + (h % 7)
                f.write(f"{t},{p},{v},X\n")
                if h == 5:
                    f.write(f"{t},{p},{v + 2},X\n")   # duplicate reading, averaged
    times = [(start - dt.timedelta(hours=1) + dt.timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M") for h in range(hours)]
    feed = {"hourly": {"time": times,
                       "temperature_2m": [float(-5 + (h % 12)) for h in range(hours)],
                       "precipitation": [0.5 if h % 9 == 0 else 0.0 for h in range(hours)],
                       "surface_pressure": [1000.0 + (h % 5) for h in range(hours)],
                       "wind_speed_10m": [float(h % 30) for h in range(hours)]}}
    with open(os.path.join(d, "weather.json"), "w") as f:
        json.dump(feed, f)


def test_route_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="envseries-flow-")
    _files(d)
    roles = {"temperature": "temperature_2m", "precipitation": "precipitation",
             "pressure": "surface_pressure", "wind_speed": "wind_speed_10m"}
    paths = flow.run(spark, os.path.join(d, "air.csv"), os.path.join(d, "weather.json"), os.path.join(d, "out"),
                     pollutants=POLL, weather_vars=WX, roles=roles,
                     pollutant_bounds=POLLUTANT_BOUNDS, weather_bounds=WEATHER_BOUNDS)
    raw = spark.read.parquet(paths["raw_long"])
    assert raw.count() == 72 * 3 - 1 + 3
    air = spark.read.parquet(paths["air_clean"])
    assert air.count() == 72
    # out-of-range NO2 was nulled then interpolated between its neighbours
    assert "no2_missing" in air.columns and "no_missing" in air.columns
    assert air.filter(F.col("no2_missing") == 1).count() == 1
    final = spark.read.parquet(paths["final"])
    # UTC instants: both sources cover 2022-12-31 23:00 .. +71 h -> 72 unique joined hours
    assert final.count() == 72 and final.select("ts").distinct().count() == 72
    assert {"hour", "season", "rain", "inversion", "no2_std", "no2_norm", "temp_category"} <= set(final.columns)
    q = {r["check"]: r for r in spark.read.json(paths["quality"]).collect()}
    assert q["time_completeness"]["ok"] and q["merge_ratio"]["value"] == 100.0
