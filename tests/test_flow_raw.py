"""The route keeps its sources as they came."""

import json

from test_flow import WX, POLL, _files

from envseries.plans import flow


def test_raw_copies_hold_all_columns_and_unparsable_values(spark, tmp_path):
    _files(str(tmp_path))
    with open(tmp_path / "air.csv", "a") as f:
        f.write("2023-01-02T00:00+0100,NO,<0.5,X\n")
    roles = {"temperature": "temperature_2m", "precipitation": "precipitation",
             "pressure": "surface_pressure", "wind_speed": "wind_speed_10m"}
    paths = flow.run(spark, str(tmp_path / "air.csv"), str(tmp_path / "weather.json"), str(tmp_path / "out"),
                     pollutants=POLL, weather_vars=WX, roles=roles)
    raw = spark.read.parquet(paths["raw_long"])
    assert raw.columns == ["Datum", "Parameter", "Wert", "Standort"] and raw.filter("Wert = '<0.5'").count() == 1
    with open(tmp_path / "weather.json") as f:
        assert json.loads(spark.read.parquet(paths["raw_feed"]).first()["value"]) == json.load(f)
    assert spark.read.parquet(paths["air_raw"]).filter("no2 = 600").count() == 1
    assert spark.read.parquet(paths["weather_raw"]).count() == 72
