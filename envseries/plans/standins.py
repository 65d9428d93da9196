"""Driver tables as stand-ins for the measurement sources.

``events`` plays the long measurement feed (ts -> timestamp, event_type ->
parameter, value -> value); ``orders`` plays a multi-year daily feed
(o_orderdate, o_orderpriority, o_totalprice).  Each base frame has a twin
SQL text in ``sqlbase`` so the oracle sees the same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, reshape
from ..session import configure

# The parameter values of the stand-in tables and their roles.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
AIR = ["click", "error", "view"]          # pollutant stand-ins
WEATHER = ["purchase", "signup"]          # weather stand-ins
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRIORITY_COLS = ["p1_urgent", "p2_high", "p3_medium", "p4_not_specified", "p5_low"]
ROLES = {"temperature": "signup", "wind_speed": "signup", "precipitation": "purchase",
         "pressure": "purchase", "sunshine": "purchase"}
ZONE = "Europe/Zurich"


_TABLES: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table as a lazy DataFrame (file listing and footer read are
    done once per session and path; the frame itself is immutable)."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, name)
    df = _TABLES.get(key)
    if df is None:
        configure(spark)
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        _TABLES[key] = df
    return df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as long measurements (ts, parameter, value)."""
    return events(spark, sf_dir).select("ts", F.col("event_type").alias("parameter"), "value")


def hourly_wide(spark: SparkSession, sf_dir: str, params=None) -> DataFrame:
    params = params or EVENT_TYPES
    return reshape.pivot_wide(events_long(spark, sf_dir), params=params, names=params)


def user_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly pivot per user: many series of very different sizes."""
    e = events(spark, sf_dir).select("user_id", "ts", F.col("event_type").alias("parameter"), "value")
    return reshape.pivot_wide(e, series=["user_id"], params=EVENT_TYPES, names=EVENT_TYPES)


def air_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_wide(spark, sf_dir, AIR)


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_wide(spark, sf_dir, WEATHER)


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pollutant and weather stand-ins inner-joined on the UTC hour."""
    return air_hourly(spark, sf_dir).join(weather_hourly(spark, sf_dir), "ts", "inner")


def final_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined table with all derived features (calendar on UTC clock)."""
    return features.feature_table(joined(spark, sf_dir), ROLES, "ts")


def orders_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("parameter"),
                    F.col("o_totalprice").alias("value"))


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily pivot of orders by priority: 80 months, gaps where a priority had no order."""
    return reshape.pivot_wide(orders_long(spark, sf_dir), params=PRIORITIES, names=PRIORITY_COLS,
                              unit="day")
