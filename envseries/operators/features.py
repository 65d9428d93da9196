"""Calendar and condition features, scaling.

Thresholds that depend on the whole column (quantiles for the inversion
flag, mean/std and min/max for scaling) are one aggregate row that is
cross-joined as a broadcast: one row, a proven size, and the plan stays
lazy (no driver round trip).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bins
from ..functions.timecols import RUSH_HOURS, season_sql
from .keyed import attach


def calendar_features(df: DataFrame, ts: str = "ts", zone: str | None = None) -> DataFrame:
    """hour, weekday (Mon=0), month, season, weekend and rush-hour flags.

    With ``zone`` the parts are taken from the local wall clock of the UTC
    instant; joins stay on the instant itself.
    """
    t = (f"CAST(from_utc_timestamp(CAST(`{ts}` AS TIMESTAMP), '{zone}') AS TIMESTAMP_NTZ)" if zone
         else f"`{ts}`")
    d = df.selectExpr("*", f"CAST(hour({t}) AS INT) AS hour", f"CAST(weekday({t}) AS INT) AS weekday",
                      f"CAST(month({t}) AS INT) AS month")
    rush = ", ".join(str(h) for h in RUSH_HOURS)
    return d.selectExpr("*", f"{season_sql('month')} AS season", "CAST(weekday >= 5 AS INT) AS is_weekend",
                        f"CAST(hour IN ({rush}) AS INT) AS is_rush_hour")


def category_features(df: DataFrame, temperature: str | None = None, wind_speed: str | None = None,
                      include_lowest: bool = False) -> DataFrame:
    """Temperature and wind categories from right-closed bins."""
    new = []
    if temperature:
        new.append(bins.right_closed_bins_sql(temperature, bins.TEMP_EDGES, bins.TEMP_LABELS, include_lowest)
                   + " AS temp_category")
    if wind_speed:
        new.append(bins.right_closed_bins_sql(wind_speed, bins.WIND_EDGES, bins.WIND_LABELS, include_lowest)
                   + " AS wind_category")
    return df.selectExpr("*", *new) if new else df


def rain_flag(df: DataFrame, precipitation: str, threshold: float = 0.1, out: str = "rain") -> DataFrame:
    """1 when precipitation > threshold; null counts as 0."""
    return df.selectExpr("*", f"CAST(coalesce(`{precipitation}` > {threshold!r}D, false) AS INT) AS `{out}`")


def joint_extreme_flag(df: DataFrame, high_col: str, low_col: str, q_high: float = 0.75,
                       q_low: float = 0.25, out: str = "inversion", approx: bool = False,
                       method: str | None = None, series: Sequence[str] = ()) -> DataFrame:
    """1 when ``high_col`` > its q_high quantile and ``low_col`` < its q_low
    quantile (inversion indicator, F8), of the whole column or of the row's
    series; nulls give 0.  ``method`` as in ``quantile.quantile_row``."""
    from .quantile import quantile_row
    method = method or ("approx" if approx else "percentile")
    d = attach(df, quantile_row(df, [(high_col, q_high, "_qh"), (low_col, q_low, "_ql")], method, series=series), series)
    flag = f"CAST(coalesce(`{high_col}` > _qh AND `{low_col}` < _ql, false) AS INT) AS `{out}`"
    return d.selectExpr(*[f"`{c}`" for c in df.columns], flag)


def unit_scale(df: DataFrame, col: str, factor: float, out: str) -> DataFrame:
    """Unit conversion by division (seconds -> hours: factor 3600, F9)."""
    return df.selectExpr("*", f"`{col}` / {float(factor)!r}D AS `{out}`")


def _x(c: str, impute_zero: bool) -> str:
    return f"coalesce(CAST(`{c}` AS DOUBLE), 0.0D)" if impute_zero else f"CAST(`{c}` AS DOUBLE)"


def _fit(df: DataFrame, cols: Sequence[str], impute_zero: bool, series: Sequence[str]) -> DataFrame:
    aggs = []
    for i, c in enumerate(cols):
        x = _x(c, impute_zero)
        aggs += [F.expr(f"avg({x}) AS _mu{i}"), F.expr(f"stddev_pop({x}) AS _sd{i}"),
                 F.expr(f"min({x}) AS _mn{i}"), F.expr(f"max({x}) AS _mx{i}")]
    return df.groupBy(*series).agg(*aggs)


def scale(df: DataFrame, cols: Sequence[str], kinds: Sequence[str] = ("std", "norm"),
          impute_zero: bool = True, fit_on: DataFrame | None = None, series: Sequence[str] = ()) -> DataFrame:
    """z-score (population std, ``{c}_std``) and min-max (``{c}_norm``) scaling
    (F10, F11).  Null is 0 before fitting and transforming (``impute_zero``);
    a zero spread divides by 1.  ``fit_on`` fits on another frame (train split).
    The fitted statistics are one row, cross-joined as a broadcast, or one
    row per series.
    """
    d = attach(df, _fit(fit_on if fit_on is not None else df, cols, impute_zero, series), series)
    outs = []
    for i, c in enumerate(cols):
        x = _x(c, impute_zero)
        if "std" in kinds:
            outs.append(f"({x} - _mu{i}) / CASE WHEN _sd{i} = 0 THEN 1.0D ELSE _sd{i} END AS `{c}_std`")
        if "norm" in kinds:
            outs.append(f"({x} - _mn{i}) / CASE WHEN _mx{i} - _mn{i} = 0 THEN 1.0D ELSE _mx{i} - _mn{i} END "
                        f"AS `{c}_norm`")
    return d.selectExpr(*[f"`{c}`" for c in df.columns], *outs)


def feature_table(df: DataFrame, roles: Mapping[str, str], ts: str = "ts", zone: str | None = None
                  ) -> DataFrame:
    """All derived features for a joined table.

    ``roles`` maps role -> column: ``temperature``, ``wind_speed``,
    ``precipitation``, ``pressure``, ``sunshine`` (any may be absent).
    """
    d = calendar_features(df, ts, zone)
    d = category_features(d, roles.get("temperature"), roles.get("wind_speed"))
    if roles.get("precipitation"):
        d = rain_flag(d, roles["precipitation"])
    if roles.get("pressure") and roles.get("temperature"):
        d = joint_extreme_flag(d, roles["pressure"], roles["temperature"])
    if roles.get("sunshine"):
        d = unit_scale(d, roles["sunshine"], 3600.0, "sunshine_h")
    return d
