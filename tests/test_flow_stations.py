"""The route on two stations and a feed in local time over both transitions of 2023; reruns and resumption."""

import datetime as dt
import json
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from envseries.operators.cleaning import POLLUTANT_BOUNDS
from envseries.plans import flow
from envseries.sources import sinks

CH = ZoneInfo("Europe/Zurich")
ROLES = {"temperature": "temperature_2m", "precipitation": "precipitation", "pressure": "surface_pressure", "wind_speed": "wind_speed_10m"}
WX = ["temperature_2m", "precipitation", "surface_pressure", "wind_speed_10m", "wind_direction_10m"]


def instants(year):
    """Three days around each transition, as UTC hours that begin and end with a local day."""
    out = []
    for month, day in ((3, 25), (10, 28)):
        at = dt.datetime(year, month, day, tzinfo=CH).astimezone(dt.timezone.utc)
        end = dt.datetime(year, month, day + 3, tzinfo=CH).astimezone(dt.timezone.utc)
        while at < end:
            out.append(at)
            at += dt.timedelta(hours=1)
    return out


def sources(folder, year, shift=0.0):
    hours = instants(year)
    with open(folder / f"air{year}.csv", "w", encoding="utf-8-sig") as f:
        f.write("Datum,Standort,Parameter,Wert\n")
        for i, t in enumerate(hours):
            for s, base in (("Nord", 10.0), ("Süd", 100.0)):
                stamp = t.astimezone(CH).strftime("%Y-%m-%dT%H:%M%z")
                f.write(f"{stamp},{s},O3,{base}\n")
                if not (s == "Nord" and i in (30, 31)):
                    f.write(f"{stamp},{s},NO2,{base + i % 11 + shift}\n")
    local = [t.astimezone(CH).strftime("%Y-%m-%dT%H:%M") for t in hours]  # 02:00 of October comes twice
    n = len(hours)
    hourly = {"time": local, "temperature_2m": [float(i) for i in range(n)], "precipitation": [0.2 * (i % 2) for i in range(n)],
              "surface_pressure": [1000.0 + i % 7 for i in range(n)], "wind_speed_10m": [float(i % 25) for i in range(n)],
              "wind_direction_10m": [None if i % 6 == 1 else 359.0 if i % 6 == 0 else 1.0 for i in range(n)]}
    with open(folder / f"weather{year}.json", "w") as f:
        json.dump({"hourly": hourly}, f)
    return str(folder / f"air{year}.csv"), str(folder / f"weather{year}.json")


def route(spark, folder, year, **more):
    air, feed = sources(folder, year, more.pop("shift", 0.0))
    return flow.run(spark, air, feed, str(folder / "out"), pollutants=["NO2", "O3"], weather_vars=WX, roles=ROLES,
                    pollutant_bounds=POLLUTANT_BOUNDS, station="Standort", zone="Europe/Zurich", weather_zone="Europe/Zurich",
                    circular=["wind_direction_10m"], **more)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("route")
    return folder, route(spark, folder, 2023, run_id="first")


def test_every_hour_of_both_stations_meets_its_own_weather(spark, written):
    _, paths = written
    hours = [t.replace(tzinfo=None) for t in instants(2023)]
    final = spark.read.parquet(paths["final"])
    rows = {(r.standort, r.ts): r for r in final.collect()}
    assert len(rows) == final.count() == 2 * len(hours) == 2 * 144
    for i, t in enumerate(hours):
        for s, base in (("Nord", 10.0), ("Süd", 100.0)):
            r = rows[s, t]
            assert r.temperature_2m == float(i), (s, t)  # joined on the instant, in the doubled and the skipped hour too
            gap = s == "Nord" and i in (30, 31)
            assert r.no2_missing == int(gap)
            if not gap:
                assert r.no2 == pytest.approx(base + i % 11)
            local = t.replace(tzinfo=dt.timezone.utc).astimezone(CH)
            assert (r.hour, r.weekday, r.month, r.year) == (local.hour, local.weekday(), local.month, 2023)
        assert rows["Nord", t].wind_direction_10m == pytest.approx([359.0, 0.0, 1.0][min(i % 6, 2)], abs=1e-9)
    # scaled per station: the same course, whatever the level
    assert rows["Süd", hours[5]].no2_norm == pytest.approx(0.5, abs=0.1) and rows["Nord", hours[5]].no2_norm == pytest.approx(0.5, abs=0.1)


def test_reports(spark, written):
    _, paths = written
    totals = {(r.source, r.stage): r for r in spark.read.json(paths["cleaning"]).collect()}
    assert [(totals["air", k].n_rows, totals["air", k].n_null_cells) for k in ("raw", "clean")] == [(288, 2), (288, 0)]
    assert totals["weather", "raw"].n_null_cells == 24 and totals["weather", "clean"].n_null_cells == 0
    assert {r.column for r in spark.read.json(paths["winsorized"]).collect()} == {"no2", "o3"}
    checks = {r.check: r for r in spark.read.json(paths["quality"]).collect()}
    assert len(checks) == 4 and not checks["time_completeness"].ok  # between the two stretches most hours are missing
    assert {r.check for r in spark.read.json(paths["warnings"]).collect()} == {"time_completeness", "plausibility"} - (
        {"plausibility"} if checks["plausibility"].ok else set())


def test_another_year_and_a_rerun_leave_the_rest(spark, written):
    folder, paths = written
    key = ["standort", "ts", "no2"]
    before = sorted(map(tuple, spark.read.parquet(paths["final"]).select(*key).collect()), key=str)
    route(spark, folder, 2024)
    both = spark.read.parquet(paths["final"])
    assert both.count() == 4 * 144
    assert sorted(r.year for r in both.select("year").distinct().collect()) == [2023, 2024]
    assert sorted(map(tuple, both.filter("year = 2023").select(*key).collect()), key=str) == before
    route(spark, folder, 2024, shift=1.0)  # corrected values: 2024 is replaced, not doubled
    again = spark.read.parquet(paths["final"])
    assert again.count() == 4 * 144
    assert again.filter("year = 2024").agg(F.max("no2")).first()[0] == pytest.approx(111.0)
    assert sorted(map(tuple, again.filter("year = 2023").select(*key).collect()), key=str) == before
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/out/raw_long").count() == 2 * 574  # a copy per source file


def test_a_broken_run_goes_on_behind_its_last_step(spark, tmp_path, monkeypatch):
    def broken(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(flow.features, "feature_table", broken)
        with pytest.raises(RuntimeError, match="lost"):
            route(spark, tmp_path, 2023, run_id="r1")
    done = sinks.Steps(spark, str(tmp_path / "out"), "r1")
    assert done.done("weather_clean") and not done.done("final") and not sinks.Steps(spark, str(tmp_path / "out"), "r2").done("air_raw")
    with monkeypatch.context() as m:
        m.setattr(flow, "clean", broken)  # cleaning is done: it must not run again
        paths = route(spark, tmp_path, 2023, run_id="r1")
    assert spark.read.parquet(paths["final"]).count() == 288
    steps = [r.step for r in done.manifest().collect()]
    assert len(steps) == len(set(steps)) == 12


def test_sources_are_parsed_once(spark, tmp_path):
    """After its copy is written, nothing reads the CSV: it may be gone."""
    import os

    from envseries.sources import readers
    air, feed = sources(tmp_path, 2023)
    original = readers.long_from_raw

    def gone(raw, **kw):
        if os.path.exists(air):
            os.rename(air, air + ".read")
        return original(raw, **kw)

    readers.long_from_raw = gone
    try:
        paths = flow.run(spark, air, feed, str(tmp_path / "out"), pollutants=["NO2", "O3"], weather_vars=WX, roles=ROLES,
                         station="Standort", weather_zone="Europe/Zurich")
    finally:
        readers.long_from_raw = original
    assert spark.read.parquet(paths["final"]).count() == 288


def test_model_results_are_written(spark, tmp_path):
    metrics = spark.createDataFrame([("line", 1.25, 2.5, 0.5)], "model string, mae double, rmse double, r2 double")
    imp = spark.createDataFrame([("hour", 0.75), ("rain", 0.25)], "feature string, importance double")
    paths = sinks.write_model_results(str(tmp_path / "model"), metrics, imp)
    back = spark.read.option("header", True).option("inferSchema", True)
    assert [tuple(r) for r in back.csv(paths["metrics"]).collect()] == [("line", 1.25, 2.5, 0.5)]
    assert {tuple(r) for r in back.csv(paths["importances"]).collect()} == {("hour", 0.75), ("rain", 0.25)}
