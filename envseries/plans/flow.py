"""The documented route, composed: sources -> clean -> align/join -> features -> sinks.

Each source is parsed once; every later step reads the table before it back.
Tables are partitioned by year and a run replaces only the years it holds, so
another year's file adds to them.  A manifest lists the steps that are
written, so a route that broke off goes on behind its last one.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecols import local_time
from ..operators import cleaning, features, quality, reshape, scan, timeline, zones
from ..session import materialize
from ..sources import readers, sinks


def clean(wide: DataFrame, cols: Sequence[str], *, series: Sequence[str] = (), ts: str = "ts",
          bounds: Mapping[str, tuple[float, float]] | None = None, limit: int = 3,
          bucket: str = "month", circular: Sequence[str] = ()) -> DataFrame:
    """De-duplicate (first row per series and hour), null out-of-range values,
    flag the columns that then have nulls, interpolate at most ``limit`` rows
    (columns in ``circular`` as directions)."""
    d = cleaning.dedupe_first(wide, [*series, ts])
    if bounds:
        d = cleaning.bounds_to_null(d, bounds)
    d = cleaning.missing_flags(d, cols)
    return scan.interpolate(d, series, ts, cols, limit=limit, bucket=bucket, circular=circular)


def align_join(left: DataFrame, right: DataFrame, *, series: Sequence[str] = (), ts: str = "ts"
               ) -> DataFrame:
    """Both sources cut to their common time window, joined on (series, UTC instant)."""
    _, a, b = timeline.overlap_filter(left, right, ts)
    clash = [c for c in b.columns if c in a.columns and c not in (*series, ts)]
    b = b.select(*[F.col(c).alias(f"{c}_right") if c in clash else F.col(c) for c in b.columns])
    return a.join(b, [*series, ts], "inner")


def cleaning_report(raw: DataFrame, cleaned: DataFrame, cols: Sequence[str], source: str) -> DataFrame:
    """Rows and null cells before and after cleaning (G29, K8), one row per stage."""
    both = cleaning.null_totals(raw, cols, "raw").union(cleaning.null_totals(cleaned, cols, "clean"))
    return both.select(F.lit(source).alias("source"), "*")


def run(spark: SparkSession, air_csv: str, weather_json: str, out_dir: str, *,
        pollutants: Sequence[str], weather_vars: Sequence[str], roles: Mapping[str, str],
        pollutant_bounds: Mapping[str, tuple[float, float]] | None = None,
        weather_bounds: Mapping[str, tuple[float, float]] | None = None,
        weather_ts_format: str = "yyyy-MM-dd'T'HH:mm", station: str | None = None,
        zone: str = "UTC", weather_zone: str = "UTC", circular: Sequence[str] = (),
        winsorize_pct: float | None = 3.0, run_id: str | None = None) -> dict[str, str]:
    """Run the route on one long measurement CSV and one hourly JSON feed.

    ``station`` names the CSV column that tells the series apart; all work
    on measurements is then per station, and the weather joins each of them.
    ``weather_zone`` is the zone of the feed's wall clocks: they become UTC
    instants before anything else, an hour that comes twice in row order.
    ``zone`` is that of the calendar: of the features, and of the ``year`` by
    which tables are partitioned.  Columns in ``circular`` are directions.
    ``winsorize_pct`` is the share beyond the 1 % and 99 % quantiles from
    which a pollutant is clipped (None: never); weather extremes are real.

    Writes under ``out_dir``: copies of both sources as text, the wide tables
    before and after cleaning, ``final`` (Parquet by year; years that are not
    in the sources stay as they are), and as JSON ``quality``, ``warnings``,
    ``cleaning`` (rows and nulls before / after), ``missing_classes`` and
    ``winsorized``; returns their paths.  With a ``run_id`` steps that are
    written under it already are skipped, so a broken run can go on.
    """
    steps = sinks.Steps(spark, out_dir, run_id)
    names = [reshape.safe_name(p) for p in pollutants]
    series = [reshape.safe_name(station)] if station else []
    bounds = {reshape.safe_name(k): v for k, v in (pollutant_bounds or {}).items()}
    year = F.year(local_time("ts", zone))

    def table(step: str, df: DataFrame) -> DataFrame:
        return steps.table(step, df.withColumn("year", year), "year").drop("year")

    csv_copy = f"raw_long/{os.path.basename(air_csv.rstrip('/'))}"
    feed_copy = f"raw_feed/{os.path.basename(weather_json.rstrip('/'))}"
    raw = steps.table(csv_copy, readers.read_raw_csv(spark, air_csv))
    steps.table(feed_copy, spark.read.text(weather_json, wholetext=True))

    long = readers.long_from_raw(raw, extra=[station] if station else [])
    if station:
        long = long.withColumnRenamed(station, series[0])
    air_raw = table("air_raw", reshape.pivot_wide(long, series=series, params=pollutants, names=names))
    air = air_raw
    if not steps.done("air_clean"):
        air = clean(air_raw, names, series=series, bounds=bounds)
        if winsorize_pct is not None:  # quantiles of a station's hours: bounded by the time span
            air = cleaning.winsorize(materialize(air), names, threshold_pct=winsorize_pct, series=series)
    air = table("air_clean", air)

    feed = readers.read_hourly_feed(spark, weather_json, weather_vars, ts_name="ts",
                                    ts_format=weather_ts_format, position="_pos")
    feed = zones.localized_by_order(feed, "ts", weather_zone, "_pos", out="_utc").drop("ts", "_pos").withColumnRenamed("_utc", "ts")
    weather_raw = table("weather_raw", feed.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")))
    weather = weather_raw if steps.done("weather_clean") else clean(weather_raw, list(weather_vars), bounds=weather_bounds, circular=circular)
    weather = table("weather_clean", weather)

    num = [*names, *weather_vars] + (["sunshine_h"] if roles.get("sunshine") else [])
    final = air
    if not steps.done("final"):
        feat = features.feature_table(align_join(air, weather), roles, "ts", None if zone == "UTC" else zone)
        final = features.scale(feat, num, series=series)
    final = table("final", final)

    rules = {**bounds, **(weather_bounds or {})}
    checks = quality.check_rows(final, air, "ts", rules, num, series=series)
    steps.report("quality", checks)
    steps.report("warnings", quality.quality_warnings(spark.read.schema(checks.schema).json(steps.path("quality")),
                                                      quality.null_shares(air, names, "air"),
                                                      quality.null_shares(weather, list(weather_vars), "weather")))
    steps.report("cleaning", cleaning_report(air_raw, air, names, "air").union(
        cleaning_report(weather_raw, weather, list(weather_vars), "weather")))
    bounded = cleaning.bounds_to_null(air_raw, bounds) if bounds else air_raw
    steps.report("missing_classes", cleaning.missingness_class(bounded, names, series))
    steps.report("winsorized", cleaning.winsorize_report(bounded, names, threshold_pct=winsorize_pct or 100.0, series=series))
    named = {"raw_long": csv_copy, "raw_feed": feed_copy}
    return {k: steps.path(named.get(k, k)) for k in (
        "raw_long", "raw_feed", "air_raw", "weather_raw", "air_clean", "weather_clean", "final", "quality", "warnings",
        "cleaning", "missing_classes", "winsorized")}
