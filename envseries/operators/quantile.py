"""Exact quantiles without a value buffer, by narrowing.

``percentile`` keeps every distinct value of a group in one aggregation
buffer and merges them in one task -- fine for a bounded table, not for a
raw group holding a third of 100 TB.  Here the linear-interpolated quantile
(position p * (n - 1)) is closed in by passes that only count:

1. a bounded sketch (``percentile_approx``) gives each wanted order
   statistic a bracket, its rank error wide on both sides;
2. one pass counts the rows below the bracket and those in it; as long as a
   bracket holds more than a page of distinct values, a sketch of the rows in
   it narrows it again, by a constant factor a pass, so the number of passes
   grows with the logarithm of the table;
3. the distinct values in a bracket, about a page at most, are picked by count.

A bracket is only a place to look: rows are counted exactly, and a sketch
that missed widens its bracket again.  Nothing is sorted, and no value is
special (infinities included).  Brackets that stop narrowing (many rare
values between two very common ones) are left to ``ranks.cumulative_counts``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ranks import cumulative_counts

#: Distinct values that the last pass may pick from, for one order statistic of one group.
PAGE = 10_000
#: Rank error of a sketch is one part in ``ACCURACY``; a pass narrows a bracket to a few parts in ``GRID``.
ACCURACY, GRID = 1_000, 256


def _q(name: str) -> str:
    return f"`{name}`"


def _keyed(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """(_g, _v): groups as one struct, so that null keys are equal to each other, and the non-null values."""
    key = F.struct(*[F.col(g).alias(g) for g in groups]) if groups else F.struct(F.lit(0).alias("_"))
    return df.select(key.alias("_g"), F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())


def _brackets(rows: DataFrame, probs: Sequence[float], accuracy: int) -> DataFrame:
    """(_g, _n, _t): per group its rows and an array of brackets, one per wanted order statistic.

    A bracket is (k, lo, hi, at): the k-th smallest value (from 0) lies in
    [lo, hi] unless the sketch missed; nulls leave a side open.
    """
    steps = sorted({p for x in probs for p in (x - 2.0 / accuracy, x + 2.0 / accuracy) if 0 < p < 1})
    listed = ", ".join(f"{p!r}D" for p in steps) or "0.5D"
    got = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"),
                                 F.expr(f"percentile_approx(_v, array({listed}), {accuracy})").alias("_a"))

    def side(p: float) -> str:
        return f"_a[{steps.index(p)}]" if p in steps else "CAST(NULL AS DOUBLE)"

    wanted = []
    for x in probs:
        lo, hi = side(x - 2.0 / accuracy), side(x + 2.0 / accuracy)
        for end in ("floor", "ceil"):
            wanted.append(f"named_struct('k', CAST({end}({x!r}D * (_n - 1)) AS BIGINT), 'lo', {lo}, 'hi', {hi})")
    # one bracket for each k, if probabilities share it
    once = "filter(_t, (t, i) -> NOT exists(slice(_t, 1, i), u -> u.k = t.k))"
    return got.selectExpr("_g", "_n", f"array({', '.join(wanted)}) AS _t").selectExpr("_g", "_n", f"{once} AS _t")


def _inside(x: str = "") -> str:
    return f"(({x}lo IS NULL OR _v >= {x}lo) AND ({x}hi IS NULL OR _v <= {x}hi))"


def _located(rows: DataFrame, targets: DataFrame, accuracy: int) -> DataFrame:
    """One counting pass: per target the rows below its bracket and in it, and a sketch of the latter.

    Rows meet the targets of their group (a few per group) in the map task
    and are aggregated before the shuffle.
    """
    met = rows.join(targets, "_g").selectExpr("_g", "_v", "inline(_t)")
    held = f"CASE WHEN {_inside()} THEN _v END"
    grid = ", ".join(f"{i / GRID!r}D" for i in range(1, GRID))
    return met.groupBy("_g", "k", "lo", "hi").agg(
        F.expr("count_if(_v < lo)").alias("below"), F.expr(f"count({held})").alias("held"),
        F.expr(f"approx_count_distinct({held})").alias("distinct"),
        F.expr(f"min({held})").alias("least"), F.expr(f"max({held})").alias("most"),
        F.expr(f"percentile_approx({held}, array({grid}), {accuracy})").alias("grid"))


def _by_position(rows: DataFrame, first: DataFrame) -> DataFrame:
    """(_g, _n, k, value) by the positions of all distinct values."""
    spots = first.selectExpr("_g", "_n", "transform(_t, t -> t.k) AS _k")
    return (cumulative_counts(rows, "_v", ["_g"]).join(spots, "_g")
            .selectExpr("_g", "_n", "explode(filter(_k, k -> k >= _before AND k < _before + _c)) AS k", "_v AS value"))


def order_statistics(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (),
                     page: int = PAGE, accuracy: int = ACCURACY) -> DataFrame:
    """(_g, _n, k, value): the order statistics that the quantiles ``probs`` of each group lie between."""
    rows = _keyed(df, value, groups)
    first = materialize(_brackets(rows, probs, accuracy))
    targets = first.select("_g", "_t")
    missed, wide = "(k < below OR k >= below + held)", f"(distinct > {int(page)})"
    before = None
    while True:
        found = materialize(_located(rows, targets, accuracy))
        now = found.selectExpr(f"count_if({missed}) AS missed", f"coalesce(sum(CASE WHEN {wide} THEN held END), 0) AS wide").first()
        if not now.missed and not now.wide:
            break
        if before is not None and now.wide >= before and not now.missed:
            return _by_position(rows, first)
        before = now.wide or None
        # a missed bracket opens on the side it missed; a wide one closes to the grid values on both sides of k
        at = f"CAST((k - below + 0.5D) / held * {GRID} AS INT)"
        closer = (f"named_struct('k', k, 'lo', CASE WHEN k < below THEN NULL WHEN {missed} OR NOT {wide} THEN lo "
                  f"WHEN {at} >= 2 THEN element_at(grid, {at} - 1) ELSE least END, "
                  f"'hi', CASE WHEN k >= below + held THEN NULL WHEN {missed} OR NOT {wide} THEN hi "
                  f"WHEN {at} <= {GRID - 3} THEN element_at(grid, {at} + 2) ELSE most END)")
        targets = found.groupBy("_g").agg(F.expr(f"collect_list({closer})").alias("_t"))
    # about a page of distinct values in a bracket: with counts, in one list
    spots = found.groupBy("_g").agg(F.expr("collect_list(named_struct('k', k, 'lo', lo, 'hi', hi, 'below', below))").alias("_t"))
    met = rows.join(spots, "_g").selectExpr("_g", "_v", f"inline(filter(_t, t -> {_inside('t.')}))")
    few = met.groupBy("_g", "k", "below", "_v").agg(F.count(F.lit(1)).alias("c"))
    lists = few.groupBy("_g", "k", "below").agg(F.expr("array_sort(collect_list(named_struct('v', _v, 'c', c)))").alias("l"))
    pick = ("aggregate(l, named_struct('n', below, 'v', CAST(NULL AS DOUBLE)), (s, x) -> named_struct('n', s.n + x.c, "
            "'v', CASE WHEN s.n <= k THEN x.v ELSE s.v END), s -> s.v)")
    return lists.join(first.select("_g", "_n"), "_g").selectExpr("_g", "_n", "k", f"{pick} AS value")


def rank_quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (), **limits) -> DataFrame:
    """Exact quantiles of ``value`` per group: rows ``(groups..., prob, value, n)``."""
    probs = [float(p) for p in probs]
    stats = order_statistics(df, value, probs, groups, **limits)
    by_k = stats.groupBy("_g", "_n").agg(F.expr("map_from_entries(collect_list(struct(k, value)))").alias("_m"))
    asked = by_k.select("*", F.explode(F.array(*[F.lit(p) for p in probs])).alias("prob"))
    h = "(prob * (_n - 1))"
    lo, hi = f"_m[CAST(floor({h}) AS BIGINT)]", f"_m[CAST(ceil({h}) AS BIGINT)]"
    return asked.selectExpr(*[f"_g.{_q(g)} AS {_q(g)}" for g in groups], "prob",
                            f"CASE WHEN {lo} = {hi} THEN {lo} ELSE (ceil({h}) - {h}) * {lo} + ({h} - floor({h})) * {hi} END AS value",
                            "_n AS n")


def rank_quantiles_wide(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str],
                        groups: Sequence[str] = ()) -> DataFrame:
    """Same, one row per group with one column per probability."""
    long = rank_quantiles(df, value, probs, groups)
    aggs = [F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(n) for p, n in zip(probs, names)]
    return long.groupBy(*groups).agg(*aggs, F.max("n").alias("n"))


def quantile_rows(df: DataFrame, specs: Sequence[tuple[str, float, str]], groups: Sequence[str] = ()) -> DataFrame:
    """One row per group with the exact quantiles ``specs`` = (column, prob, alias); every column in the same passes."""
    cols = sorted({c for c, _, _ in specs})
    probs = sorted({float(p) for _, p, _ in specs})
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = df.selectExpr(*[_q(g) for g in groups], f"stack({len(cols)}, {pairs}) AS (_col, _val)")
    q = rank_quantiles(long, "_val", probs, [*groups, "_col"])
    if groups:  # a series without any value keeps its row, with nulls
        q = q.unionByName(df.select(*groups).distinct(), allowMissingColumns=True)
    return q.groupBy(*groups).agg(*[F.expr(f"max(CASE WHEN _col = '{c}' AND prob = {float(p)!r}D THEN value END) AS `{a}`")
                                    for c, p, a in specs])


def quantile_row(df: DataFrame, specs: Sequence[tuple[str, float, str]], method: str = "percentile",
                 accuracy: int = 10000, series: Sequence[str] = ()) -> DataFrame:
    """The requested quantiles ``specs`` = (column, prob, alias): one row, or one per series.

    ``method``: ``"rank"`` (exact by narrowing, no value buffer -- raw
    tables), ``"percentile"`` (exact, buffers a column's values -- only for
    tables bounded by the time span) or ``"approx"`` (``percentile_approx``).
    Meant for ``keyed.attach``, which broadcasts the one row (a proven size).
    """
    if method == "rank":
        return quantile_rows(df, specs, series)
    if method == "approx":
        return df.groupBy(*series).agg(*[F.expr(f"CAST(percentile_approx(`{c}`, {float(p)!r}, {accuracy}) AS DOUBLE) AS `{a}`")
                                         for c, p, a in specs])
    if method != "percentile":
        raise ValueError(f"unknown quantile method {method!r}")
    return df.groupBy(*series).agg(*[F.expr(f"CAST(percentile(`{c}`, {float(p)!r}) AS DOUBLE) AS `{a}`") for c, p, a in specs])
