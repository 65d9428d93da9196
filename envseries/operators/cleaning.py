"""Cleaning: de-duplication, range rules, missing flags and classes, winsorising."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import scan
from .keyed import attach

# Plausible ranges (min, max) the reference applies.
POLLUTANT_BOUNDS = {
    "NO": (0, 500), "NO2": (0, 300), "O3": (0, 300), "PM10": (0, 500), "PM2.5": (0, 300),
}
WEATHER_BOUNDS = {
    "temperature_2m": (-30, 45), "relative_humidity_2m": (0, 100), "precipitation": (0, 150),
    "wind_speed_10m": (0, 200), "surface_pressure": (920, 1060), "cloud_cover": (0, 100),
    "sunshine_duration": (0, 3600),
}


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Keep one row per key: the first by ``order`` (default all other columns).

    ``min(struct(order..., rest...))`` is an ordinary aggregate, so Spark
    combines map-side: a key holding a third of the table collapses to one
    row per map task before the shuffle (a ``row_number`` window would sort
    the whole hot key in one task).  The order is total, hence the survivor
    does not depend on input order or partitioning.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order = list(order) if order is not None else rest
    tail = [c for c in rest if c not in order]
    fields = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    fields += [F.col(c).alias(f"_t{i}") for i, c in enumerate(tail)]
    best = df.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("_best"))
    cols = [F.col(k) for k in keys]
    cols += [F.col(f"_best._o{i}").alias(c) for i, c in enumerate(order)]
    cols += [F.col(f"_best._t{i}").alias(c) for i, c in enumerate(tail)]
    return best.select(*cols).select(*df.columns)


def resolve_rules(columns: Sequence[str], rules: Mapping[str, tuple[float, float]],
                  substring: bool = False, exclude: Sequence[str] = ("timestamp", "Datum", "ts")
                  ) -> list[tuple[str, float, float]]:
    """Rule -> column resolution at plan time: exact names, or case-insensitive
    substring matches (a rule may then hit several columns)."""
    out = []
    for key, (lo, hi) in rules.items():
        if substring:
            hits = [c for c in columns if key.upper() in c.upper() and c not in exclude]
        else:
            hits = [c for c in columns if c == key]
        out += [(c, lo, hi) for c in hits]
    return out


def bounds_to_null(df: DataFrame, rules: Mapping[str, tuple[float, float]],
                   substring: bool = False) -> DataFrame:
    """Values outside [min, max] become null (one projection, rules applied in order)."""
    cur = {c: F.col(c) for c in df.columns}
    for c, lo, hi in resolve_rules(df.columns, rules, substring):
        x = cur[c]
        cur[c] = F.when(~((x < lo) | (x > hi)) | x.isNull(), x)
    return df.select(*[cur[c].alias(c) for c in df.columns])


def negative_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~(F.col(c) < 0) | F.col(c).isNull(), F.col(c)) for c in cols})


def bounds_violations(df: DataFrame, rules: Mapping[str, tuple[float, float]],
                      substring: bool = False) -> DataFrame:
    """Rows outside the rule per column (G28 / G29): one aggregate for all rules."""
    resolved = resolve_rules(df.columns, rules, substring)
    aggs = []
    for i, (c, lo, hi) in enumerate(resolved):
        aggs.append(F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"_v{i}"))
    row = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("column"), F.lit(float(lo)).alias("min_rule"),
                      F.lit(float(hi)).alias("max_rule"), F.col(f"_v{i}").alias("n_violations"))
             for i, (c, lo, hi) in enumerate(resolved)]
    return row.select(F.inline(F.array(*parts)))


def observed_nulls(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The frame, written once to the checkpoint folder, and those of ``cols`` in which that run met a null."""
    seen = Observation()
    out = materialize(df.observe(seen, *[F.expr(f"count_if(`{c}` IS NULL) AS `n{i}`") for i, c in enumerate(cols)]))
    counts = seen.get
    return out, [c for i, c in enumerate(cols) if counts[f"n{i}"] > 0]


def missing_flags(df: DataFrame, cols: Sequence[str], only_with_nulls: bool = True,
                  suffix: str = "_missing") -> DataFrame:
    """``{c}_missing`` int 0/1 for columns with any null (or all given columns).

    The schema of the flags depends on the data.  They are counted while the
    frame is written to the checkpoint folder, and the result reads it from
    there: what leads to the frame runs once.
    """
    targets = list(cols)
    if only_with_nulls:
        df, targets = observed_nulls(df, cols)
    return df.withColumns({f"{c}{suffix}": F.col(c).isNull().cast("int") for c in targets})


def monthly_missing_rate(df: DataFrame, cols: Sequence[str], series: Sequence[str] = (),
                         ts: str = "ts") -> DataFrame:
    """Share of null rows per (series, year, month) and column, in percent."""
    g = df.groupBy(*series, F.year(ts).alias("year"), F.month(ts).alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in cols])
    return g.unpivot([*series, "year", "month", "n_rows"], list(cols), "column", "missing_pct")


def missingness_class(df: DataFrame, cols: Sequence[str], series: Sequence[str] = (),
                      ts: str = "ts", bucket: str = "month") -> DataFrame:
    """Console classifier (K4): monthly-rate variation coefficient (sample std)
    and longest null run; rules evaluated in this order:
    cv < 0.4 and run <= 6 -> MCAR; cv >= 0.6 -> MAR; run > 24 -> MCAR (outage);
    else MAR/MCAR.  Only columns with at least one null are reported.
    """
    series = list(series)
    rates = monthly_missing_rate(df, cols, series, ts)
    cv = rates.groupBy(*series, "column").agg(
        F.avg("missing_pct").alias("_m"), F.stddev_samp("missing_pct").alias("_s"))
    cv = cv.withColumn("cv", F.when(F.col("_m") > 0, F.try_divide(F.col("_s"), F.col("_m")))
                       .otherwise(F.lit(0.0))).drop("_m", "_s")
    counts = df.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    ).unpivot([*series, "n_rows"], list(cols), "column", "n_missing")
    runs = scan.null_runs(df, series, ts, cols, bucket)
    out = counts.filter(F.col("n_missing") > 0).join(cv, [*series, "column"]).join(runs, [*series, "column"])
    cls = (F.when((F.col("cv") < 0.4) & (F.col("max_run") <= 6), "MCAR")
           .when(F.col("cv") >= 0.6, "MAR")
           .when(F.col("max_run") > 24, "MCAR (outage)")
           .otherwise("MAR/MCAR"))
    return out.select(*series, "column", "n_missing",
                      (F.col("n_missing") * 100.0 / F.col("n_rows")).alias("missing_pct"),
                      "cv", "max_run", cls.alias("missing_class"))


def missingness_class_matrix(df: DataFrame, cols: Sequence[str], series: Sequence[str] = (),
                             ts: str = "ts") -> DataFrame:
    """Matrix classifier (K5): null rate per month of the years spanned (absent
    months 0), population std; cv >= 0.5 and at most half of the months
    active (rate > 5 %) -> MAR; cv < 0.35 -> MCAR; else mixed.  Lists the
    active months, by number within one year, else as year-month.
    """
    series = list(series)
    per_m = df.groupBy(*series, F.year(ts).alias("year"), F.month(ts).alias("month")).agg(
        *[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols])
    long = per_m.unpivot([*series, "year", "month"], list(cols), "column", "rate")
    agg = long.groupBy(*series, "column").agg(
        F.sum("rate").alias("_sum"), F.sum(F.col("rate") * F.col("rate")).alias("_sq"), F.max("rate").alias("_max"),
        ((F.max("year") - F.min("year") + 1) * 12).alias("_slots"),
        F.expr("array_sort(collect_list(CASE WHEN rate > 0.05 THEN struct(year, month) END))").alias("active_months"))
    one_year = F.col("_slots") == 12
    # the slots without rows are 0: mean and population std over all of them
    mean = F.col("_sum") / F.col("_slots")
    var = F.greatest(F.col("_sq") / F.col("_slots") - mean * mean, F.lit(0.0))
    agg = agg.filter(F.col("_max") > 0).withColumn(
        "cv", F.when(mean > 0, F.sqrt(var) / mean).otherwise(F.lit(0.0)))
    n_active = F.size("active_months")
    cls = (F.when((F.col("cv") >= 0.5) & (n_active * 2 <= F.col("_slots")), "MAR")
           .when(F.col("cv") < 0.35, "MCAR")
           .otherwise("MCAR/MAR"))
    return agg.select(*series, "column", "cv", n_active.alias("n_active"),
                      F.array_join(F.transform("active_months", lambda m: F.when(one_year, m["month"].cast("string")).otherwise(
                          F.format_string("%04d-%02d", m["year"], m["month"]))), ",").alias("active_months"),
                      cls.alias("missing_class"))


def _outside(df: DataFrame, cols: Sequence[str], q_low: float, q_high: float, method: str, accuracy: int,
             series: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their series' quantile bounds ``_lo_c`` / ``_hi_c``; per series bounds, values outside and all values."""
    from .quantile import quantile_row
    specs = [(c, p, f"_{tag}_{c}") for c in cols for tag, p in (("lo", q_low), ("hi", q_high))]
    th = quantile_row(df, specs, method, accuracy, series)
    if method == "rank":
        th = materialize(th)  # passes over the table lie behind it; both uses below read their result
    d = attach(df, th, series)
    aggs = []
    for c in cols:
        aggs += [F.expr(f"first(`_lo_{c}`) AS `_lo_{c}`"), F.expr(f"first(`_hi_{c}`) AS `_hi_{c}`"),
                 F.expr(f"count_if(`{c}` < `_lo_{c}` OR `{c}` > `_hi_{c}`) AS `_out_{c}`"), F.expr(f"count(`{c}`) AS `_all_{c}`")]
    return d, d.groupBy(*series).agg(*aggs)


def winsorize(df: DataFrame, cols: Sequence[str], q_low: float = 0.01, q_high: float = 0.99,
              threshold_pct: float = 3.0, approx: bool = False, accuracy: int = 10000,
              method: str | None = None, series: Sequence[str] = ()) -> DataFrame:
    """Clip to [q_low, q_high] quantiles a column whose share of values outside
    exceeds ``threshold_pct`` percent of its non-null values.

    Bounds and decision are one row, cross-joined as a broadcast, or one row
    per series; the whole decision stays inside the plan.  ``method`` as in
    ``quantile.quantile_row`` (``approx=True`` = "approx").
    """
    method = method or ("approx" if approx else "percentile")
    _, counts = _outside(df, cols, q_low, q_high, method, accuracy, series)
    decided = counts.selectExpr(*[f"`{s}`" for s in series], *[x for c in cols for x in (
        f"`_lo_{c}`", f"`_hi_{c}`", f"coalesce(try_divide(`_out_{c}` * 100.0D, `_all_{c}`) > {float(threshold_pct)!r}D, false) AS `_do_{c}`")])
    d = attach(df, decided, series)
    clipped = {c: f"CASE WHEN `_do_{c}` AND `{c}` < `_lo_{c}` THEN `_lo_{c}` WHEN `_do_{c}` AND `{c}` > `_hi_{c}` "
                  f"THEN `_hi_{c}` ELSE `{c}` END AS `{c}`" for c in cols}
    return d.selectExpr(*[clipped.get(c, f"`{c}`") for c in df.columns])


def winsorize_report(df: DataFrame, cols: Sequence[str], q_low: float = 0.01, q_high: float = 0.99,
                     threshold_pct: float = 3.0, method: str = "percentile", series: Sequence[str] = ()) -> DataFrame:
    """Per (series and) column: quantile bounds, share outside, whether clipping applies."""
    _, counts = _outside(df, cols, q_low, q_high, method, 10000, series)
    structs = ", ".join(f"named_struct('column', '{c}', 'q_low', `_lo_{c}`, 'q_high', `_hi_{c}`, 'n_outside', `_out_{c}`, "
                        f"'outside_pct', try_divide(`_out_{c}` * 100.0D, `_all_{c}`))" for c in cols)
    rows = counts.selectExpr(*[f"`{s}`" for s in series], f"inline(array({structs}))")
    return rows.withColumn("winsorized", F.coalesce(F.col("outside_pct") > threshold_pct, F.lit(False)))


def null_totals(df: DataFrame, cols: Sequence[str], stage: str) -> DataFrame:
    """One row: stage, rows, null cells over ``cols`` (K8 / G29 before-after)."""
    total = None
    for c in cols:
        e = F.count_if(F.col(c).isNull())
        total = e if total is None else total + e
    return df.agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("n_rows"),
                  total.cast("bigint").alias("n_null_cells"))


def row_first_keep_window(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``row_number`` variant of ``dedupe_first`` (for small keys / comparison)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
