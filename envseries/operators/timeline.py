"""Calendar spines, missing periods, completeness, resampling, rolling windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import floor_to
from .scan import forward_fill, rolling_rows
from .zones import localized, localized_filled

_SECONDS = {"hour": 3600, "day": 86400, "minute": 60}


def _interval(unit: str) -> Column:
    return F.expr(f"INTERVAL 1 {unit.upper()}")


def observed_range(df: DataFrame, series: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """First and last timestamp per series."""
    return df.groupBy(*series).agg(F.min(ts).alias("ts_min"), F.max(ts).alias("ts_max"),
                                   F.count(F.lit(1)).alias("n_rows"))


def spine(df: DataFrame, series: Sequence[str] = (), ts: str = "ts", unit: str = "hour") -> DataFrame:
    """Every expected period between each series' first and last period.

    One bounds row per series is exploded; the spine size is bounded by the
    time span, not by the row count.
    """
    b = df.groupBy(*series).agg(F.min(floor_to(ts, unit)).alias("_lo"),
                                F.max(floor_to(ts, unit)).alias("_hi"))
    return b.select(*series, F.explode(F.sequence("_lo", "_hi", _interval(unit))).alias(ts))


def missing_periods(df: DataFrame, series: Sequence[str] = (), ts: str = "ts",
                    unit: str = "hour") -> DataFrame:
    """Expected periods with no row (T9 / J3): spine ``left_anti`` present periods."""
    present = df.select(*series, floor_to(ts, unit).alias(ts)).distinct()  # reduced before the shuffle
    return spine(df, series, ts, unit).join(present, [*series, ts], "left_anti")


def expected_count(lo: Column, hi: Column, unit: str) -> Column:
    """Number of periods in [lo, hi] without building the spine."""
    sec = _SECONDS[unit]
    return ((F.unix_micros(hi.cast("timestamp")) - F.unix_micros(lo.cast("timestamp")))
            / (sec * 1_000_000)).cast("bigint") + 1


def completeness(df: DataFrame, series: Sequence[str] = (), ts: str = "ts",
                 unit: str = "hour", threshold: float = 95.0) -> DataFrame:
    """Time completeness (Q1 distinct-based) and row-based variant (Q2).

    ``expected`` is computed arithmetically from first/last period, so no
    spine is materialised; distinct periods use a partial aggregate.
    """
    # two-level aggregation (series, period) -> series: raw rows collapse
    # map-side to one row per period, and no distinct-aggregate expansion
    per = df.groupBy(*series, floor_to(ts, unit).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    agg = per.groupBy(*series).agg(
        F.min("_p").alias("ts_min"), F.max("_p").alias("ts_max"),
        F.sum("_c").alias("n_rows"), F.count(F.lit(1)).alias("n_present"))
    exp = expected_count(F.col("ts_min"), F.col("ts_max"), unit)
    return (agg.withColumn("n_expected", exp)
            .withColumn("n_missing", F.col("n_expected") - F.col("n_present"))
            .withColumn("completeness_pct", F.col("n_present") * 100.0 / F.col("n_expected"))
            .withColumn("row_completeness_pct", F.col("n_rows") * 100.0 / F.col("n_expected"))
            .withColumn("ok", F.col("completeness_pct") >= threshold))


def overlap_filter(a: DataFrame, b: DataFrame, ts: str = "ts") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Common time window of two sources and both sources cut to it.

    The window is one row; it is cross-joined as a broadcast (size 1, proven).
    Returns ``(window, a_cut, b_cut)``.
    """
    wa = a.agg(F.min(ts).alias("a_min"), F.max(ts).alias("a_max"))
    wb = b.agg(F.min(ts).alias("b_min"), F.max(ts).alias("b_max"))
    win = wa.crossJoin(wb).select(
        F.greatest("a_min", "b_min").alias("start"), F.least("a_max", "b_max").alias("end"))
    cut_a = a.crossJoin(F.broadcast(win)).filter(F.col(ts).between(F.col("start"), F.col("end"))) \
        .drop("start", "end")
    cut_b = b.crossJoin(F.broadcast(win)).filter(F.col(ts).between(F.col("start"), F.col("end"))) \
        .drop("start", "end")
    return win, cut_a, cut_b


def resample(df: DataFrame, aggs: Mapping[str, Column], series: Sequence[str] = (),
             ts: str = "ts", unit: str = "day", fill_spine: bool = True,
             zero_fill: Sequence[str] = ()) -> DataFrame:
    """Aggregate to a coarser period; empty periods appear (spine) with null,
    or 0 for the columns in ``zero_fill`` (sums of an empty period are 0).
    """
    g = df.groupBy(*series, floor_to(ts, unit).alias(ts)).agg(
        *[expr.alias(name) for name, expr in aggs.items()])
    if fill_spine:
        g = spine(df, series, ts, unit).join(g, [*series, ts], "left")
    for c in zero_fill:
        g = g.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    return g


def rolling_centered(df: DataFrame, col: str, series: Sequence[str] = (), ts: str = "ts",
                     unit: str = "day", window: int = 7, min_periods: int = 4,
                     out: str = "rolling") -> DataFrame:
    """Centred rolling mean over a regular (spine) series.

    On a complete spine ``rows between -h and +h`` equals ``periods between
    -h and +h``; ``scan.rolling_rows`` windows (series, bucket) and carries
    the rows around a bucket's edges, so no series is one window.
    """
    h = window // 2
    bucket = {"day": "year", "hour": "month", "minute": "day"}[unit]
    return rolling_rows(df, series, ts, col, h, window - 1 - h, max(min_periods, 1), out, bucket)


def localize_filled(df: DataFrame, ts: str, zone: str, series: Sequence[str] = (),
                    out: str = "ts_utc", order: str | None = None, bucket: str = "month") -> DataFrame:
    """Localise wall clocks (T5), then fill the instants that came out null
    (ambiguous fall-back hours) with the previous row's instant (T6).

    By wall clock the previous row is the same for a whole fold, so nothing
    is sorted (``zones.localized_filled``).  With another ``order`` the fill
    is the segmented forward fill.
    """
    if order is None or order == ts:
        return localized_filled(df, ts, zone, series, out)
    return forward_fill(localized(df, ts, zone, out), series, order, [out], bucket=bucket)
