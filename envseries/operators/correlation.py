"""Correlation: Pearson and Spearman matrices, rankings, lag correlation, trends.

Matrices are tidy rows ``(var_a, var_b, r, n)`` over pairwise-complete rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import pearson
from . import scan
from .ranks import average_rank


def _pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def pearson_matrix(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None
                   ) -> DataFrame:
    """Pearson r for every pair (C1), one aggregate pass for all pairs."""
    pairs = list(pairs) if pairs is not None else _pairs(cols)
    aggs = []
    for i, (a, b) in enumerate(pairs):
        aggs += [pearson(a, b).alias(f"_r{i}"), F.expr(f"count_if(`{a}` IS NOT NULL AND `{b}` IS NOT NULL) AS _n{i}")]
    row = df.agg(*aggs)
    parts = [f"named_struct('var_a', '{a}', 'var_b', '{b}', 'r', _r{i}, 'n', _n{i})" for i, (a, b) in enumerate(pairs)]
    return row.selectExpr(f"inline(array({', '.join(parts)}))")


def _pair_long(df: DataFrame, pairs: Sequence[tuple[str, str]], decimals: int | None) -> DataFrame:
    """(var_a, var_b, x, y) rows of every pair, pairwise complete."""
    def rnd(c):
        x = f"CAST(`{c}` AS DOUBLE)"
        return f"round({x}, {decimals})" if decimals is not None else x
    arr = ", ".join(f"named_struct('var_a', '{a}', 'var_b', '{b}', 'x', {rnd(a)}, 'y', {rnd(b)})" for a, b in pairs)
    return df.selectExpr(f"inline(array({arr}))").filter("x IS NOT NULL AND y IS NOT NULL")


def ranked_pairs(pairs: DataFrame, groups: Sequence[str], ids: Sequence[str], x: str, y: str,
                 decimals: int | None = 6) -> DataFrame:
    """Average ranks of ``x`` and ``y`` within ``groups`` in ONE rank pass.

    ``ids`` must identify a row within its group (e.g. a time key or a
    position).  Both sides are stacked, ranked per (groups, side) and pivoted
    back on (groups, ids); output: groups, ids, ``_x``, ``_y``, ``_rx``, ``_ry``.
    """
    groups, ids = list(groups), list(ids)
    rnd = (lambda c: f"round({c}, {decimals})") if decimals is not None else (lambda c: c)
    xs, ys = f"CAST(`{x}` AS DOUBLE)", f"CAST(`{y}` AS DOUBLE)"
    long = pairs.selectExpr(*[f"`{c}`" for c in groups + ids],
                            f"inline(array(named_struct('_side', 0, '_v', {rnd(xs)}, '_raw', {xs}), "
                            f"named_struct('_side', 1, '_v', {rnd(ys)}, '_raw', {ys})))")
    ranked = average_rank(long, "_v", [*groups, "_side"], "_rk")
    return ranked.groupBy(*groups, *ids).agg(
        F.expr("max(CASE WHEN _side = 0 THEN _raw END) AS _x"), F.expr("max(CASE WHEN _side = 1 THEN _raw END) AS _y"),
        F.expr("max(CASE WHEN _side = 0 THEN _rk END) AS _rx"), F.expr("max(CASE WHEN _side = 1 THEN _rk END) AS _ry"))


def spearman_matrix(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None,
                    decimals: int | None = 6, materialize: bool = False,
                    key: Sequence[str] | None = None) -> DataFrame:
    """Spearman rho for every pair (C2): average ranks on the pair's complete
    rows, then Pearson of the ranks.  Inputs are rounded to ``decimals`` so
    that float noise neither creates nor breaks ties.  With a unique row
    ``key`` both sides are ranked in one pass (``ranked_pairs``).
    """
    pairs = list(pairs) if pairs is not None else _pairs(cols)
    if key:
        key = list(key)
        arr = ", ".join(f"named_struct('var_a', '{a}', 'var_b', '{b}', 'x', CAST(`{a}` AS DOUBLE), "
                        f"'y', CAST(`{b}` AS DOUBLE))" for a, b in pairs)
        long = df.selectExpr(*[f"`{k}`" for k in key], f"inline(array({arr}))") \
                 .filter("x IS NOT NULL AND y IS NOT NULL")
        r = ranked_pairs(long, ["var_a", "var_b"], key, "x", "y", decimals)
        return r.groupBy("var_a", "var_b").agg(pearson("_rx", "_ry").alias("rho"), F.expr("count(1) AS n"))
    long = _pair_long(df, pairs, decimals)
    if materialize:
        from ..session import materialize as _mat
        long = _mat(long)
    r = average_rank(long, "x", ["var_a", "var_b"], "rx")
    r = average_rank(r, "y", ["var_a", "var_b"], "ry")
    return r.groupBy("var_a", "var_b").agg(pearson("rx", "ry").alias("rho"),
                                           F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, a: str, b: str, decimals: int | None = 6,
             key: Sequence[str] | None = None) -> DataFrame:
    return spearman_matrix(df, [a, b], decimals=decimals, key=key)


def top_pairs(matrix: DataFrame, left: Sequence[str], right: Sequence[str], k: int = 10,
              stat: str = "r") -> DataFrame:
    """Top-k cross pairs (left x right) by |r| with sign (C3); ties by names."""
    m = matrix.filter((F.col("var_a").isin(list(left)) & F.col("var_b").isin(list(right)))
                      | (F.col("var_a").isin(list(right)) & F.col("var_b").isin(list(left))))
    m = m.filter(F.col(stat).isNotNull()).withColumn("abs_r", F.abs(F.col(stat)))
    return m.orderBy(F.col("abs_r").desc(), "var_a", "var_b").limit(k)


def target_relevance(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Correlation of each feature with the target, ranked by |r| (C4)."""
    m = pearson_matrix(df, [], pairs=[(f, target) for f in features])
    return (m.select(F.col("var_a").alias("feature"), "r", "n")
            .withColumn("rank", F.row_number().over(Window.orderBy(
                F.abs(F.col("r")).desc_nulls_last(), F.col("feature")))))


def conditional_correlation(df: DataFrame, a: str, b: str, condition: Column) -> DataFrame:
    """Pearson r of a, b among rows satisfying ``condition``."""
    return pearson_matrix(df.filter(condition), [a, b])


def lag_correlation(df: DataFrame, x: str, y: str, max_lag: int = 6, series: Sequence[str] = (),
                    ts: str = "ts", decimals: int | None = 6, bucket: str = "month",
                    spearman: bool = True) -> DataFrame:
    """Correlation of ``x`` shifted by k rows with ``y``, k = 0..max_lag.

    Rows with null x or y are dropped first, then shifted by position (row,
    not time): all lags are columns of one window per bucket (``scan.lags``),
    and Pearson of all lags is one aggregate.  Spearman ranks each lag's valid
    pairs.  A lag without pairs has no row.

    Without ``series`` the pairs of lag k are all rows but the last k of x and
    the first k of y, so both columns are ranked once and a rank is lowered
    by the few left-out values below it.  With ``series`` these are k values
    of every series; then each lag is ranked on its own.
    """
    series = list(series)
    span = range(max_lag + 1)
    clean = df.select(*series, ts, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
              .na.drop(subset=["_x", "_y"])
    if not spearman or series:
        wide = scan.lags(clean, series, ts, {f"_x{k}": ("_x", k) for k in span}, bucket)
    if spearman and series:
        arr = ", ".join(f"named_struct('lag', {k}, '_xl', _x{k})" for k in span)
        pairs = wide.selectExpr(*[f"`{c}`" for c in [*series, ts]], "_y", f"inline(array({arr}))").filter("_xl IS NOT NULL")
        ranked = ranked_pairs(pairs, ["lag"], [*series, ts], "_xl", "_y", decimals)
        return ranked.groupBy("lag").agg(pearson("_x", "_y").alias("pearson"), F.expr("count(1) AS n"),
                                         pearson("_rx", "_ry").alias("spearman"))
    aggs = [a for k in span for a in (pearson(f"_x{k}", "_y").alias(f"_p{k}"), F.expr(f"count(_x{k}) AS _n{k}"))]
    fields = ["'lag', {k}", "'pearson', _p{k}", "'n', _n{k}"]
    if spearman:
        rnd = f"round({{0}}, {decimals})" if decimals is not None else "{0}"
        ranked = ranked_pairs(clean, [], [ts], "_x", "_y", decimals)
        edges = _first_values(clean, F.col(ts).desc(), rnd.format("_x"), "_xs", max_lag).crossJoin(
            F.broadcast(_first_values(clean, F.col(ts).asc(), rnd.format("_y"), "_ys", max_lag)))
        cols = {f"{c}{k}": (c, k) for c in ("_x", "_rx") for k in span}
        wide = scan.lags(ranked, [], ts, cols, bucket).crossJoin(F.broadcast(edges))

        def lowered(rank: str, value: str, left_out: str) -> str:
            v = rnd.format(value)
            return (f"aggregate({left_out}, {rank}, (s, o) -> s - CASE WHEN o < {v} THEN 1.0D WHEN o = {v} THEN 0.5D ELSE 0.0D END)")

        wide = wide.selectExpr(
            "_y", *[f"_x{k}" for k in span],
            *[f"{lowered(f'_rx{k}', f'_x{k}', f'slice(_xs, 1, {k})')} AS _a{k}" for k in span],
            *[f"{lowered('_ry', '_y', f'slice(_ys, 1, {k})')} AS _b{k}" for k in span])
        aggs += [pearson(f"_a{k}", f"_b{k}").alias(f"_s{k}") for k in span]
        fields.append("'spearman', _s{k}")
    structs = ", ".join(f"named_struct({', '.join(fields).format(k=k)})" for k in span)
    return wide.agg(*aggs).selectExpr(f"inline(array({structs}))").filter("n > 0")


def _first_values(df: DataFrame, order: Column, value: str, out: str, k: int) -> DataFrame:
    """One row with the array of the first ``k`` values by ``order`` (a top-k, not a sort)."""
    top = df.orderBy(order).limit(max(k, 1)).withColumn("_i", F.monotonically_increasing_id())
    return top.agg(F.expr(f"transform(array_sort(collect_list(named_struct('i', _i, 'v', {value}))), t -> t.v) AS {out}"))


def strongest_lag(lags: DataFrame) -> DataFrame:
    """Lag with the smallest (most negative) Pearson r."""
    return lags.agg(F.min_by("lag", "pearson").alias("lag"), F.min("pearson").alias("pearson"))


def quad_trend(df: DataFrame, x: str, y: str, group: Sequence[str] = (), min_n: int = 10) -> DataFrame:
    """Least-squares parabola y = c0 + c1 x + c2 x^2 per group, only n > min_n.

    Power sums on centred x (two passes: mean, then sums) and a 3x3 solve by
    Cramer's rule in column expressions: no matrix leaves the executors.
    """
    group = list(group)
    d = df.select(*group, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
          .na.drop(subset=["_x", "_y"])
    m = d.groupBy(*group).agg(F.avg("_x").alias("_mx"), F.count(F.lit(1)).alias("n"))
    d = d.join(m, group) if group else d.crossJoin(F.broadcast(m))
    u = F.col("_x") - F.col("_mx")
    s = d.groupBy(*group).agg(
        F.first("n").alias("n"), F.first("_mx").alias("_mx"),
        F.sum(u).alias("s1"), F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"),
        F.sum(u * u * u * u).alias("s4"), F.sum("_y").alias("t0"), F.sum(u * F.col("_y")).alias("t1"),
        F.sum(u * u * F.col("_y")).alias("t2"))
    n, s1, s2, s3, s4 = (F.col("n").cast("double"), F.col("s1"), F.col("s2"), F.col("s3"), F.col("s4"))
    t0, t1, t2 = F.col("t0"), F.col("t1"), F.col("t2")

    def det3(a, b, c, d_, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d_ * i - f * g) + c * (d_ * h - e * g)

    det = det3(n, s1, s2, s1, s2, s3, s2, s3, s4)
    a0 = F.try_divide(det3(t0, s1, s2, t1, s2, s3, t2, s3, s4), det)
    a1 = F.try_divide(det3(n, t0, s2, s1, t1, s3, s2, t2, s4), det)
    a2 = F.try_divide(det3(n, s1, t0, s1, s2, t1, s2, s3, t2), det)
    mx = F.col("_mx")
    out = s.select(*group, "n", (a2).alias("c2"), (a1 - 2 * a2 * mx).alias("c1"),
                   (a0 - a1 * mx + a2 * mx * mx).alias("c0"))
    return out.filter(F.col("n") > min_n)


def quad_curve(df: DataFrame, x: str, y: str, points: int = 200, min_n: int = 10) -> DataFrame:
    """The fitted parabola evaluated at ``points`` equally spaced x in [min, max]."""
    coef = quad_trend(df, x, y, min_n=min_n)
    rng = df.agg(F.min(x).cast("double").alias("_lo"), F.max(x).cast("double").alias("_hi"))
    g = coef.crossJoin(rng).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    xv = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("i") / float(points - 1)
    return g.select("i", xv.alias("x"), (F.col("c0") + F.col("c1") * xv + F.col("c2") * xv * xv).alias("y_fit"))


def binned_scatter(df: DataFrame, x: str, y: str, group: Sequence[str] = (), bins: int = 50) -> DataFrame:
    """2-D equal-width histogram of (x, y) per group (C8 at scale)."""
    group = list(group)
    d = df.select(*group, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
          .na.drop(subset=["_x", "_y"])
    r = d.agg(F.min("_x").alias("_xl"), F.max("_x").alias("_xh"), F.min("_y").alias("_yl"),
              F.max("_y").alias("_yh"))
    d = d.crossJoin(F.broadcast(r))

    def bucket(v, lo, hi):
        w = (F.col(hi) - F.col(lo)) / bins
        b = F.when(F.col(hi) == F.col(lo), 0).otherwise(F.floor((F.col(v) - F.col(lo)) / w))
        return F.least(b, F.lit(bins - 1)).cast("int")

    return (d.groupBy(*group, bucket("_x", "_xl", "_xh").alias("x_bin"), bucket("_y", "_yl", "_yh").alias("y_bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("x_mean"), F.avg("_y").alias("y_mean")))
