"""Sources and sinks: BOM CSV, nested hourly JSON, table writes."""

import datetime as dt
import json
import os
import tempfile

from envseries.sources import readers, sinks


def test_long_csv_with_bom_and_offset(spark):
    d = tempfile.mkdtemp(prefix="envseries-test-")
    path = os.path.join(d, "air.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("Datum,Parameter,Wert,Standort\n")
        f.write("2023-01-01T00:00+0100,NO2,21.5,Z\n2023-01-01T01:00+0100,PM2.5,NaN,Z\n")
    df = readers.read_long_csv(spark, path, extra=["Standort"])
    rows = df.orderBy("ts").collect()
    assert rows[0].ts == dt.datetime(2022, 12, 31, 23) and rows[0].parameter == "NO2"
    assert rows[0].value == 21.5 and rows[1].value is None


def test_hourly_feed_parallel_arrays(spark):
    d = tempfile.mkdtemp(prefix="envseries-test-")
    path = os.path.join(d, "w.json")
    doc = {"hourly": {"time": ["2023-01-01T00:00", "2023-01-01T01:00", "2023-01-01T02:00"],
                      "temperature_2m": [1.5, None, 2.5], "precipitation": [0.0, 0.2, None]}}
    with open(path, "w") as f:
        json.dump(doc, f)
    df = readers.read_hourly_feed(spark, path, ["temperature_2m", "precipitation"])
    rows = df.orderBy("Datum").collect()
    assert len(rows) == 3
    assert [(r.temperature_2m, r.precipitation) for r in rows] == [(1.5, 0.0), (None, 0.2), (2.5, None)]
    assert rows[1].Datum == dt.datetime(2023, 1, 1, 1)


def test_table_round_trip_partitioned(spark):
    d = tempfile.mkdtemp(prefix="envseries-test-")
    df = spark.createDataFrame([(dt.datetime(2023, 5, 1), 1.0), (dt.datetime(2024, 5, 1), 2.0)],
                               "ts timestamp_ntz, v double")
    sinks.write_table(sinks.with_year(df, "ts"), os.path.join(d, "t"), partition_by=["year"])
    back = spark.read.parquet(os.path.join(d, "t"))
    assert sorted(r.year for r in back.collect()) == [2023, 2024]
    assert back.filter("year = 2024").count() == 1
    sinks.write_report(df, os.path.join(d, "r"))
    assert spark.read.json(os.path.join(d, "r")).count() == 2


def test_wide_csv_first_column_becomes_timestamp(spark):
    from pyspark.sql import types as T
    d = tempfile.mkdtemp(prefix="envseries-test-")
    path = os.path.join(d, "wide.csv")
    with open(path, "w") as f:
        f.write("Datum,NO,PM2.5\n2023-01-01 00:00:00,3.5,NaN\n2023-01-01 01:00:00,,2.0\n")
    schema = T.StructType([T.StructField("Datum", T.StringType()), T.StructField("NO", T.DoubleType()),
                           T.StructField("pm25", T.DoubleType())])
    rows = readers.read_wide_csv(spark, path, schema).orderBy("timestamp").collect()
    assert rows[0].timestamp == dt.datetime(2023, 1, 1) and rows[0].pm25 is None and rows[1].NO is None
