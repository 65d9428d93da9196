"""Profiling: null shares, column profiles, describe, duplicates, quantiles, IQR.

Every profile is a single aggregate pass producing one wide row, turned
into tidy rows with ``inline`` (no per-column re-scans).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.units import limits_of, units_of
from .keyed import attach
from .quantile import quantile_row


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, num) and f.name not in exclude]


def _q(name: str) -> str:
    return f"`{name}`"


def _lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"CAST({float(v)!r} AS DOUBLE)"


def _tidy(row: DataFrame, structs: Sequence[str]) -> DataFrame:
    """One wide aggregate row -> one row per struct (``inline``), in SQL text."""
    return row.selectExpr(f"inline(array({', '.join(structs)}))")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = True
                 ) -> DataFrame:
    """Null count and percent per column (G3 / K7), largest first."""
    cols = list(cols) if cols is not None else df.columns
    row = df.agg(F.expr("count(1) AS _n"),
                 *[F.expr(f"count_if({_q(c)} IS NULL) AS _z{i}") for i, c in enumerate(cols)])
    out = _tidy(row, [f"named_struct('column', {_lit(c)}, 'n_null', _z{i}, 'null_pct', _z{i} * 100.0D / _n)"
                      for i, c in enumerate(cols)])
    if only_missing:
        out = out.filter("n_null > 0")
    return out


def _null_cells(cols: Sequence[str]) -> str:
    return "CAST(" + " + ".join(f"count_if({_q(c)} IS NULL)" for c in cols) + " AS BIGINT)"


def table_null_share(df: DataFrame, cols: Sequence[str] | None = None, warn_pct: float = 20.0
                     ) -> DataFrame:
    """Share of null cells over all (numeric) cells of the table."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    row = df.agg(F.expr("count(1) AS n_rows"), F.expr(f"{_null_cells(cols)} AS n_null_cells"))
    return row.selectExpr("n_rows", "n_null_cells", f"n_rows * {len(cols)} AS n_cells",
                          f"try_divide(n_null_cells * 100.0D, n_rows * {len(cols)}) AS null_pct",
                          f"coalesce(try_divide(n_null_cells * 100.0D, n_rows * {len(cols)}) > {warn_pct!r}, false)"
                          " AS warn")


def column_profile(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False
                   ) -> DataFrame:
    """dtype, min, max (as strings), distinct count per column, nulls excluded.

    Distinct values are counted column by column, each in two levels of
    aggregation over a scan of that column alone: several distinct counts in
    one aggregate would multiply every row by their number.  ``approx``
    counts all columns in one pass.
    """
    cols = list(cols) if cols is not None else df.columns
    types = dict(df.dtypes)
    if approx:
        aggs = []
        for i, c in enumerate(cols):
            x = _q(c)
            aggs += [F.expr(f"CAST(min({x}) AS STRING) AS _mn{i}"), F.expr(f"CAST(max({x}) AS STRING) AS _mx{i}"),
                     F.expr(f"approx_count_distinct({x}) AS _d{i}"), F.expr(f"count({x}) AS _c{i}")]
        return _tidy(df.agg(*aggs), [
            f"named_struct('column', {_lit(c)}, 'dtype', {_lit(types[c])}, 'min_value', _mn{i}, "
            f"'max_value', _mx{i}, 'n_distinct', _d{i}, 'n_non_null', _c{i})" for i, c in enumerate(cols)])
    parts = []
    for c in cols:
        values = df.selectExpr(f"{_q(c)} AS _v").groupBy("_v").agg(F.expr("count(1) AS _c"))
        parts.append(values.agg(
            F.expr(f"{_lit(c)} AS column"), F.expr(f"{_lit(types[c])} AS dtype"), F.expr("CAST(min(_v) AS STRING) AS min_value"),
            F.expr("CAST(max(_v) AS STRING) AS max_value"), F.expr("count(_v) AS n_distinct"),
            F.expr("coalesce(sum(CASE WHEN _v IS NOT NULL THEN _c END), 0) AS n_non_null")))
    return reduce(DataFrame.union, parts)


def distinct_sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by..., column, sketch): a mergeable distinct-count sketch per part of the table, to be stored with it."""
    aggs = [F.expr(f"hll_sketch_agg(CAST({_q(c)} AS STRING)) AS _s{i}") for i, c in enumerate(cols)]
    structs = ", ".join(f"named_struct('column', {_lit(c)}, 'sketch', _s{i})" for i, c in enumerate(cols))
    return df.groupBy(*by).agg(*aggs).selectExpr(*[_q(b) for b in by], f"inline(array({structs}))")


def distinct_estimates(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, n_distinct) estimated from stored sketches; no row of the tables is read again."""
    return sketches.groupBy(*by, "column").agg(F.expr("hll_sketch_estimate(hll_union_agg(sketch)) AS n_distinct"))


def describe(df: DataFrame, cols: Sequence[str], approx: bool = False, method: str | None = None) -> DataFrame:
    """count, mean, sample std, min, median, max per column.

    The median follows ``method`` as in ``quantile.quantile_row``; with
    ``"rank"`` it comes from a separate one-row frame (no value buffer).
    """
    method = method or ("approx" if approx else "percentile")
    aggs = []
    for i, c in enumerate(cols):
        x = _q(c)
        aggs += [F.expr(f"count({x}) AS _n{i}"), F.expr(f"avg({x}) AS _a{i}"), F.expr(f"stddev_samp({x}) AS _s{i}"),
                 F.expr(f"CAST(min({x}) AS DOUBLE) AS _mn{i}"), F.expr(f"CAST(max({x}) AS DOUBLE) AS _mx{i}")]
        if method == "percentile":
            aggs.append(F.expr(f"CAST(median({x}) AS DOUBLE) AS _md{i}"))
        elif method == "approx":
            aggs.append(F.expr(f"CAST(percentile_approx({x}, 0.5, 10000) AS DOUBLE) AS _md{i}"))
    row = df.agg(*aggs)
    if method == "rank":
        row = row.crossJoin(quantile_row(df, [(c, 0.5, f"_md{i}") for i, c in enumerate(cols)], "rank"))
    return _tidy(row, [f"named_struct('column', {_lit(c)}, 'n', _n{i}, 'mean', _a{i}, 'std', _s{i}, 'min', _mn{i}, "
                       f"'median', _md{i}, 'max', _mx{i})" for i, c in enumerate(cols)])


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full-row duplicates and duplicate keys.

    ``count(*) - count(distinct ...)`` via two grouped pre-aggregations, so a
    hot key is combined map-side.
    """
    # the row total falls out of the distinct-row counts: two scans, not three
    rows = df.groupBy(*df.columns).count().agg(F.count(F.lit(1)).alias("n_distinct_rows"),
                                               F.sum("count").alias("n_rows"))
    ks = df.groupBy(*keys).count().agg(F.count(F.lit(1)).alias("n_distinct_keys"))
    out = rows.crossJoin(ks)
    return out.select("n_rows", (F.col("n_rows") - F.col("n_distinct_rows")).alias("n_duplicate_rows"),
                      (F.col("n_rows") - F.col("n_distinct_keys")).alias("n_duplicate_keys"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99),
              approx: bool = False, accuracy: int = 10000, method: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles per column.

    ``method`` as in ``quantile.quantile_row``: exact ``percentile`` (default),
    exact by ``rank`` for raw tables, or ``approx``.
    """
    method = method or ("approx" if approx else "percentile")
    specs = [(c, float(p), f"_q{i}_{j}") for i, c in enumerate(cols) for j, p in enumerate(probs)]
    row = quantile_row(df, specs, method, accuracy)
    return _tidy(row, [f"named_struct('column', {_lit(c)}, 'prob', {_lit(p)}, 'value', {a})" for c, p, a in specs])


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5, flag_pct: float = 5.0,
                 approx: bool = False, method: str | None = None, series: Sequence[str] = ()) -> DataFrame:
    """Q1, Q3, IQR, fences and outlier count / percent per (series and) column.

    Pass 1: quartiles (one row, broadcast, or one per series; ``method`` as
    in ``quantile.quantile_row``). Pass 2: conditional counts.
    """
    method = method or ("approx" if approx else "percentile")
    th = quantile_row(df, [(c, p, f"_{t}{i}") for i, c in enumerate(cols) for t, p in (("a", 0.25), ("b", 0.75))],
                      method, series=series)
    th = th.selectExpr(*[_q(s) for s in series], *[x for i in range(len(cols)) for x in (
        f"_a{i} AS q1_{i}", f"_b{i} AS q3_{i}", f"_a{i} - {k!r} * (_b{i} - _a{i}) AS lo_{i}",
        f"_b{i} + {k!r} * (_b{i} - _a{i}) AS hi_{i}")])
    d = attach(df.select(*series, *cols), th, series)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.expr(f"first(q1_{i}) AS q1_{i}"), F.expr(f"first(q3_{i}) AS q3_{i}"),
                 F.expr(f"first(lo_{i}) AS lo_{i}"), F.expr(f"first(hi_{i}) AS hi_{i}"),
                 F.expr(f"count_if({_q(c)} < lo_{i} OR {_q(c)} > hi_{i}) AS o_{i}"), F.expr(f"count({_q(c)}) AS n_{i}")]
    structs = [
        f"named_struct('column', {_lit(c)}, 'q1', q1_{i}, 'q3', q3_{i}, 'iqr', q3_{i} - q1_{i}, "
        f"'lower_fence', lo_{i}, 'upper_fence', hi_{i}, 'n_outliers', o_{i}, "
        f"'outlier_pct', try_divide(o_{i} * 100.0D, n_{i}))" for i, c in enumerate(cols)]
    out = d.groupBy(*series).agg(*aggs).selectExpr(*[_q(s) for s in series], f"inline(array({', '.join(structs)}))")
    return out.selectExpr("*", f"coalesce(outlier_pct > {flag_pct!r}, false) AS flag")


def headline_stats(df: DataFrame, cols: Sequence[str], ts: str, units: Mapping[str, str] | None = None
                   ) -> DataFrame:
    """Non-null count, first and last timestamp with a value, mean, unit (G26); by default the library's units (P10)."""
    units = units_of(cols) if units is None else units
    aggs = []
    for i, c in enumerate(cols):
        x, t = _q(c), _q(ts)
        aggs += [F.expr(f"count({x}) AS _n{i}"), F.expr(f"min(CASE WHEN {x} IS NOT NULL THEN {t} END) AS _f{i}"),
                 F.expr(f"max(CASE WHEN {x} IS NOT NULL THEN {t} END) AS _l{i}"), F.expr(f"avg({x}) AS _a{i}")]
    return _tidy(df.agg(*aggs), [
        f"named_struct('column', {_lit(c)}, 'n', _n{i}, 'first_ts', _f{i}, 'last_ts', _l{i}, 'mean', _a{i}, "
        f"'unit', {_lit(units.get(c, ''))})" for i, c in enumerate(cols)])


def limit_exceedance(df: DataFrame, limits: Mapping[str, float] | None = None) -> DataFrame:
    """Per column with a limit: rows above it, share of non-null rows (P11); by default the library's health limits."""
    limits = limits_of(df.columns) if limits is None else limits
    cols = list(limits)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.expr(f"count_if({_q(c)} > {float(limits[c])!r}) AS _e{i}"), F.expr(f"count({_q(c)}) AS _n{i}")]
    return _tidy(df.agg(*aggs), [
        f"named_struct('column', {_lit(c)}, 'limit_value', {_lit(limits[c])}, 'n_exceed', _e{i}, "
        f"'exceed_pct', try_divide(_e{i} * 100.0D, _n{i}))" for i, c in enumerate(cols)])


def source_catalog(entries: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Per source: rows, columns, total null cells, licence, URL.

    ``entries`` = (name, frame, licence, url); one aggregate per source,
    combined with ``unionByName``.
    """
    out = None
    for name, df, licence, url in entries:
        total = None
        for c in df.columns:
            e = F.count_if(F.col(c).isNull())
            total = e if total is None else total + e
        row = df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n_rows"),
                     F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
                     total.cast("bigint").alias("n_null_cells"),
                     F.lit(licence).alias("licence"), F.lit(url).alias("url"))
        out = row if out is None else out.unionByName(row)
    return out


def preview(df: DataFrame, order: Sequence[str], k: int = 5) -> DataFrame:
    """First k rows by ``order`` (A10); a TakeOrdered top-k, not a full sort."""
    return df.orderBy(*order).limit(k)
