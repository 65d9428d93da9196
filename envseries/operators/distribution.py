"""Distribution summaries: box statistics, histograms, group profiles, contrasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import sector
from ..session import materialize
from .ranks import cumulative_counts


def box_stats(df: DataFrame, value: str, group: Sequence[str], k: float = 1.5,
              approx: bool = False, method: str = "percentile") -> DataFrame:
    """Box-plot numbers per group (G16 / G17): quartiles, whiskers (the most
    extreme values inside the 1.5 IQR fences), outlier count, mean, n.

    ``method="rank"`` reads the input once: everything comes from its
    distinct values with counts and positions (``ranks.cumulative_counts``),
    no group is buffered or sorted in one task.  Use it when a group is a
    large share of a raw table; otherwise the quartiles are one aggregate
    and the fences a second pass.
    """
    group = list(group)
    d = df.select(*group, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if method == "rank":
        return _box_from_counts(d, group, k)
    qs = F.percentile_approx("_v", [0.25, 0.5, 0.75], 10000) if approx else F.percentile("_v", [0.25, 0.5, 0.75])
    q = d.groupBy(*group).agg(qs.alias("_q"), F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("n"))
    q = q.select(*group, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                 F.col("_q")[2].alias("q3"), "mean", "n")
    return _with_whiskers(d.withColumn("_c", F.lit(1)), q, group, k)


def _box_from_counts(d: DataFrame, group: list[str], k: float) -> DataFrame:
    c = materialize(cumulative_counts(d, "_v", group))
    size = c.groupBy(*group).agg(F.sum("_c").alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"))
    at = c.join(size, group) if group else c.crossJoin(F.broadcast(size))
    aggs = []
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        for end in ("floor", "ceil"):
            here = f"{end}({p}D * (n - 1))"
            aggs.append(F.expr(f"max(CASE WHEN {here} >= _before AND {here} < _before + _c THEN _v END)").alias(f"_{end}_{name}"))
    q = at.groupBy(*group, "n", "mean").agg(*aggs)

    def between(name: str, p: float) -> str:
        h = f"({p}D * (n - 1))"
        lo, hi = f"_floor_{name}", f"_ceil_{name}"
        return f"CASE WHEN {lo} = {hi} THEN {lo} ELSE (ceil({h}) - {h}) * {lo} + ({h} - floor({h})) * {hi} END AS {name}"

    q = q.selectExpr(*[f"`{g}`" for g in group], between("q1", 0.25), between("median", 0.5), between("q3", 0.75), "mean", "n")
    return _with_whiskers(c.select(*group, "_v", "_c"), q, group, k)


def _with_whiskers(d: DataFrame, q: DataFrame, group: list[str], k: float) -> DataFrame:
    """``q`` with whiskers and outlier count from the values ``_v`` of ``d``, ``_c`` rows each."""
    fences = q.withColumn("_lo", F.col("q1") - k * (F.col("q3") - F.col("q1"))) \
              .withColumn("_hi", F.col("q3") + k * (F.col("q3") - F.col("q1")))
    j = d.join(fences, group) if group else d.crossJoin(F.broadcast(fences))
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    own = ["q1", "median", "q3", "mean", "n"]
    return j.groupBy(*group, *own).agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("_c"))).cast("bigint").alias("n_outliers"))


def histogram(df: DataFrame, value: str, bins: int = 60, group: Sequence[str] = (),
              density: bool = False, method: str = "percentile") -> DataFrame:
    """Equal-width histogram over each group's [min, max]; the last bin is closed;
    empty bins appear with 0 (G18 / G19); a group with one distinct value uses
    [v - 0.5, v + 0.5].  Adds the group mean and median.
    ``density`` divides counts by (n * bin width).
    """
    group = list(group)
    d = df.select(*group, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if method == "rank":  # median by rank: no per-group value buffer
        from .quantile import rank_quantiles
        med = rank_quantiles(d, "_v", [0.5], group).select(*group, F.col("value").alias("median"))
        r = d.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                                  F.count(F.lit(1)).alias("n_total"), F.avg("_v").alias("mean"))
        r = r.join(med, group) if group else r.crossJoin(med)
    else:
        r = d.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                                  F.count(F.lit(1)).alias("n_total"), F.avg("_v").alias("mean"),
                                  F.median("_v").alias("median"))
    # a single distinct value spans [v - 0.5, v + 0.5], as numpy's histogram does
    r = r.selectExpr(*[f"`{g}`" for g in group], "n_total", "mean", "median",
                     "CASE WHEN _hi = _lo THEN _lo - 0.5D ELSE _lo END AS _lo",
                     "CASE WHEN _hi = _lo THEN _hi + 0.5D ELSE _hi END AS _hi")
    width = (F.col("_hi") - F.col("_lo")) / bins
    j = d.join(r, group) if group else d.crossJoin(F.broadcast(r))
    b = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(
        F.floor((F.col("_v") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)))
    counts = j.groupBy(*group, F.least(b, F.lit(bins - 1)).cast("int").alias("bin")) \
              .agg(F.count(F.lit(1)).alias("n"))
    dom = r.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = dom.join(counts, [*group, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumn("bin_low", F.col("_lo") + width * F.col("bin")) \
             .withColumn("bin_high", F.col("_lo") + width * (F.col("bin") + 1))
    cols = [*group, "bin", "bin_low", "bin_high", "n", "n_total", "mean", "median"]
    if density:
        out = out.withColumn("density", F.try_divide(F.col("n").cast("double"),
                                                     F.col("n_total") * width))
        cols.append("density")
    return out.select(*cols)


def group_stat(df: DataFrame, value: str | Sequence[str], group: Sequence[str], stat: str = "median",
               method: str = "percentile") -> DataFrame:
    """Median / mean / sum of one or more values per group.

    ``method="rank"`` computes medians by rank (``quantile.py``) instead of
    buffering a group's values -- for groups that are a large share of a raw table.
    """
    values = [value] if isinstance(value, str) else list(value)
    group = list(group)
    if stat == "median" and method == "rank":
        from .quantile import rank_quantiles
        pairs = ", ".join(f"'{v}', CAST(`{v}` AS DOUBLE)" for v in values)
        long = df.selectExpr(*[f"`{g}`" for g in group], f"stack({len(values)}, {pairs}) AS (_col, _val)")
        q = rank_quantiles(long, "_val", [0.5], [*group, "_col"])
        med = q.groupBy(*group).agg(*[F.expr(f"max(CASE WHEN _col = '{v}' THEN value END) AS `{v}`") for v in values])
        keys = df.select(*group).distinct()  # groups whose values are all null keep a null median
        return keys.join(med, group, "left") if group else med
    fn = {"median": F.median, "mean": F.avg, "sum": F.sum, "count": F.count}[stat]
    return df.groupBy(*group).agg(*[fn(v).alias(v) for v in values])


def flag_share(df: DataFrame, flag: str, group: Sequence[str]) -> DataFrame:
    """Share of rows with the 0/1 flag set, in percent, per group."""
    return df.groupBy(*group).agg((F.avg(flag) * 100).alias("share_pct"), F.count(F.lit(1)).alias("n"))


def two_group_contrast(df: DataFrame, value: str, flag: str, baseline: int = 0) -> DataFrame:
    """Means of the two flag groups, difference (other - baseline) and its share
    of the baseline mean in percent (G24) -- one conditional aggregate."""
    other = 1 - baseline
    m0 = F.avg(F.when(F.col(flag) == baseline, F.col(value)))
    m1 = F.avg(F.when(F.col(flag) == other, F.col(value)))
    row = df.agg(m0.alias("mean_base"), m1.alias("mean_other"),
                 F.count(F.when(F.col(flag) == baseline, F.col(value))).alias("n_base"),
                 F.count(F.when(F.col(flag) == other, F.col(value))).alias("n_other"))
    diff = F.col("mean_other") - F.col("mean_base")
    return row.withColumn("diff", diff).withColumn(
        "diff_pct", F.try_divide(diff * 100.0, F.col("mean_base")))


def sector_mean(df: DataFrame, direction: str | Column, value: str, n: int = 16) -> DataFrame:
    """Mean value per direction sector (G25): pmod 360, 16 sectors of 22.5 degrees
    with the lowest edge included; sectors without data -> 0 (J5)."""
    width = 360.0 / n
    dircol = F.col(direction) if isinstance(direction, str) else direction
    d = df.select(dircol.cast("double").alias("_d"), F.col(value).cast("double").alias("_v")) \
          .na.drop(subset=["_d", "_v"])
    g = d.groupBy(sector(F.col("_d"), width, n).alias("sector")).agg(
        F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("n"))
    dom = df.sparkSession.range(n).select(F.col("id").cast("int").alias("sector"))
    out = dom.join(F.broadcast(g), "sector", "left")
    return out.select("sector", (F.col("sector") * width).alias("deg_low"),
                      ((F.col("sector") + 1) * width).alias("deg_high"),
                      F.coalesce("mean", F.lit(0.0)).alias("mean"),
                      F.coalesce("n", F.lit(0)).alias("n"))
