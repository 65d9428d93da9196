"""Long <-> wide reshaping of measurement tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import floor_to


def safe_name(value: str) -> str:
    """Column name for a parameter value (``PM2.5`` -> ``pm25``)."""
    return re.sub(r"[^0-9a-z]+", "_", value.lower().replace(".", "")).strip("_")


def period_mean(df: DataFrame, *, series: Sequence[str] = (), ts: str = "ts",
                parameter: str = "parameter", value: str = "value",
                params: Sequence[str] | None = None, unit: str = "hour") -> DataFrame:
    """Mean per (series, period, parameter): collapses duplicate readings.

    Output: ``series..., ts, parameter, value_mean, n``.  The ``IN`` filter on
    the parameter is pushed into the scan.
    """
    d = df
    if params is not None:
        d = d.filter(F.col(parameter).isin(list(params)))
    return (d.groupBy(*series, floor_to(ts, unit).alias("ts"), F.col(parameter).alias("parameter"))
            .agg(F.avg(value).alias("value_mean"), F.count(value).alias("n")))


def pivot_wide(df: DataFrame, *, series: Sequence[str] = (), ts: str = "ts",
               parameter: str = "parameter", value: str = "value",
               params: Sequence[str], names: Sequence[str] | None = None,
               unit: str = "hour", agg: str = "avg") -> DataFrame:
    """Long -> wide: one row per (series, period), one column per parameter.

    Expressed as a single conditional aggregation (one hash aggregate with
    map-side partial aggregation, one shuffle on (series, period)); values
    are explicit so no distinct pass is needed.  A hot period or series is
    reduced map-side before the shuffle.
    """
    names = list(names) if names is not None else [safe_name(p) for p in params]
    if agg not in ("avg", "sum", "min", "max", "count"):
        raise ValueError(agg)

    def lit(v: str) -> str:
        return "'" + v.replace("'", "''") + "'"
    aggs = [F.expr(f"{agg}(CASE WHEN `{parameter}` = {lit(p)} THEN `{value}` END) AS `{n}`")
            for p, n in zip(params, names)]
    return (df.filter(F.col(parameter).isin(list(params)))
            .groupBy(*series, floor_to(ts, unit).alias("ts"))
            .agg(*aggs))


def unpivot_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
                 name: str = "parameter", value: str = "value", drop_null: bool = True) -> DataFrame:
    """Wide -> long (tidy) rows."""
    out = df.unpivot(list(ids), list(cols), name, value)
    return out.filter(F.col(value).isNotNull()) if drop_null else out
