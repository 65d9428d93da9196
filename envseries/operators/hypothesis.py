"""Declarative hypothesis tests: correlation and two-group tests, verdicts.

Each test is one aggregate row (counts, means, variances, correlation);
statistics and p-values are column expressions on that row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import pearson, t_from_r
from ..functions.tdist import t_pvalue, t_pvalue_sql
from .correlation import spearman


@dataclass(frozen=True)
class Hypothesis:
    id: str
    expected: str          # "positive" | "negative"
    variables: tuple[str, str]
    method: str            # "correlation" | "group"
    text: str = ""


# The four declared hypotheses (variables by their role names).
HYPOTHESES = (
    Hypothesis("H1", "negative", ("precipitation", "PM10"), "correlation",
               "Precipitation lowers PM10 (wash-out)"),
    Hypothesis("H2", "positive", ("inversion_indikator", "NO"), "group",
               "Inversions raise NO"),
    Hypothesis("H3", "positive", ("temperature_2m", "O3"), "correlation",
               "High temperatures raise O3"),
    Hypothesis("H4", "positive", ("ist_rush_hour", "NO2"), "group",
               "Rush hours show higher NO2"),
)


def corr_test(df: DataFrame, a: str, b: str, decimals: int | None = 6,
              key: Sequence[str] | None = None) -> DataFrame:
    """Pearson r, t, p and Spearman rho, t, p over pairwise-complete rows (H1).
    ``key`` (a unique row key) lets the ranks be computed in one pass."""
    pr = df.agg(pearson(a, b).alias("r"),
                F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"))
    sp = spearman(df, a, b, decimals, key=key).select("rho")
    row = pr.crossJoin(sp)
    row = row.withColumn("t", t_from_r(F.col("r"), F.col("n"))) \
             .withColumn("t_s", t_from_r(F.col("rho"), F.col("n")))
    row = row.withColumn("_dof", F.col("n") - 2)
    row = row.withColumns({"p": t_pvalue("t", "_dof"), "p_rho": t_pvalue("t_s", "_dof")})
    return row.select(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), "n", "r", "t", "p", "rho", "p_rho")


def group_aggregates(df: DataFrame, flag: str, value: str) -> DataFrame:
    """n, mean, sample variance of ``value`` for flag = 0 and 1 (one pass)."""
    def g(k):
        return F.when(F.col(flag) == k, F.col(value).cast("double"))
    return df.agg(F.count(g(0)).alias("n0"), F.count(g(1)).alias("n1"),
                  F.avg(g(0)).alias("mean0"), F.avg(g(1)).alias("mean1"),
                  F.var_samp(g(0)).alias("var0"), F.var_samp(g(1)).alias("var1"))


def welch_columns(row: DataFrame) -> DataFrame:
    """Welch t, Welch-Satterthwaite df, p, difference and Cohen's d (H2, H3)."""
    se0 = F.col("var0") / F.col("n0")
    se1 = F.col("var1") / F.col("n1")
    se = se0 + se1
    diff = F.col("mean1") - F.col("mean0")
    dof = F.try_divide(se * se, se0 * se0 / (F.col("n0") - 1) + se1 * se1 / (F.col("n1") - 1))
    pooled = F.sqrt((F.col("var0") + F.col("var1")) / 2.0)
    return (row.withColumn("diff", diff)
            .withColumn("t", F.try_divide(diff, F.sqrt(se)))
            .withColumn("dof", dof)
            .withColumn("p", t_pvalue("t", "dof"))
            .withColumn("cohens_d", F.when(pooled > 0, F.try_divide(diff, pooled)).otherwise(F.lit(0.0))))


def welch_test(df: DataFrame, flag: str, value: str) -> DataFrame:
    return welch_columns(group_aggregates(df, flag, value))


def verdict(expected: str, effect: Column, p: Column, strength: Column, threshold: float,
            skipped: Column | None = None) -> Column:
    """Rules in this order: n/a; direction ok & p < 0.05 & strong -> confirmed;
    direction ok & p < 0.05 -> partly (weak); wrong direction -> not confirmed;
    else partly (not significant).  Null comparisons count as false."""
    direction = (effect < 0) if expected == "negative" else (effect > 0)
    dir_ok = F.coalesce(direction, F.lit(False))
    sig = F.coalesce(p < 0.05, F.lit(False))
    strong = F.coalesce(F.abs(strength) >= threshold, F.lit(False))
    v = F.when(dir_ok & sig & strong, "confirmed") \
         .when(dir_ok & sig, "partly (weak)") \
         .when(~dir_ok, "not confirmed") \
         .otherwise("partly (not significant)")
    if skipped is not None:
        v = F.when(skipped, "n/a").otherwise(v)
    return v


def verdict_sql(expected: str, effect: str, p: str, strength: str, threshold: float,
                skipped: str = "false") -> str:
    """SQL text of ``verdict`` (same rules, same order)."""
    direction = f"({effect}) < 0" if expected == "negative" else f"({effect}) > 0"
    dir_ok = f"coalesce({direction}, false)"
    sig = f"coalesce(({p}) < 0.05D, false)"
    strong = f"coalesce(abs({strength}) >= {threshold!r}D, false)"
    return (f"CASE WHEN {skipped} THEN 'n/a' WHEN {dir_ok} AND {sig} AND {strong} THEN 'confirmed' "
            f"WHEN {dir_ok} AND {sig} THEN 'partly (weak)' WHEN NOT {dir_ok} THEN 'not confirmed' "
            f"ELSE 'partly (not significant)' END")


def evaluate(df: DataFrame, hypotheses: Sequence[Hypothesis], columns: Mapping[str, str],
             min_group: int = 5) -> DataFrame:
    """Verdict per hypothesis (H4, H5) -- all hypotheses in ONE aggregate pass.

    Correlation hypotheses need Pearson r and n; group hypotheses need
    per-group n, mean and variance.  All of these are plain aggregates, so
    every declared test compiles into a single ``agg`` over one scan; t, df,
    p and the verdict are expressions on that one row, which ``inline``
    turns into one row per hypothesis.  ``columns`` maps variable names to
    columns of ``df``; an unmapped variable gives ``n/a`` (H4).
    """
    aggs, parts, tstats, pvals = [], [], [], []
    for i, h in enumerate(hypotheses):
        a, b = (columns.get(v) for v in h.variables)
        missing = a is None or b is None or a not in df.columns or b not in df.columns
        if missing:
            effect = p = strength = "CAST(NULL AS DOUBLE)"
            n, v = "CAST(NULL AS BIGINT)", "'n/a'"
        elif h.method == "correlation":
            aggs += [pearson(a, b).alias(f"_r{i}"),
                     F.expr(f"count_if(`{a}` IS NOT NULL AND `{b}` IS NOT NULL) AS _n{i}")]
            tstats += [f"try_divide(_r{i} * sqrt(CAST(_n{i} - 2 AS DOUBLE)), sqrt(1 - _r{i} * _r{i})) AS _t{i}",
                       f"_n{i} - 2 AS _df{i}"]
            pvals.append(f"{t_pvalue_sql(f'_t{i}', f'_df{i}')} AS _p{i}")
            effect = strength = f"_r{i}"
            p, n = f"_p{i}", f"_n{i}"
            v = verdict_sql(h.expected, effect, p, strength, 0.10)
        else:
            def g(k, a=a, b=b):
                return f"CASE WHEN `{a}` = {k} THEN CAST(`{b}` AS DOUBLE) END"
            aggs += [F.expr(f"count({g(0)}) AS _n0{i}"), F.expr(f"count({g(1)}) AS _n1{i}"),
                     F.expr(f"avg({g(0)}) AS _m0{i}"), F.expr(f"avg({g(1)}) AS _m1{i}"),
                     F.expr(f"var_samp({g(0)}) AS _v0{i}"), F.expr(f"var_samp({g(1)}) AS _v1{i}")]
            se0, se1 = f"(_v0{i} / _n0{i})", f"(_v1{i} / _n1{i})"
            diff = f"(_m1{i} - _m0{i})"
            tstats += [f"try_divide({diff}, sqrt({se0} + {se1})) AS _t{i}",
                       f"try_divide(({se0} + {se1}) * ({se0} + {se1}), "
                       f"{se0} * {se0} / (_n0{i} - 1) + {se1} * {se1} / (_n1{i} - 1)) AS _df{i}"]
            pvals.append(f"{t_pvalue_sql(f'_t{i}', f'_df{i}')} AS _p{i}")
            pooled = f"sqrt((_v0{i} + _v1{i}) / 2.0D)"
            strength = f"(CASE WHEN {pooled} > 0 THEN try_divide({diff}, {pooled}) ELSE 0.0D END)"
            effect, p, n = diff, f"_p{i}", f"(_n0{i} + _n1{i})"
            v = verdict_sql(h.expected, effect, p, strength, 0.20, f"(_n0{i} < {min_group} OR _n1{i} < {min_group})")
        parts.append(f"named_struct('id', '{h.id}', 'method', '{h.method}', 'expected', '{h.expected}', "
                     f"'effect', CAST({effect} AS DOUBLE), 'p', CAST({p} AS DOUBLE), "
                     f"'strength', CAST({strength} AS DOUBLE), 'n', CAST({n} AS BIGINT), 'verdict', {v})")
    row = df.agg(*aggs) if aggs else df.sparkSession.range(1)
    # t / df, then p-values in their own projections: each fold is evaluated
    # once and the verdict rules reference the result column
    if pvals:
        row = row.selectExpr("*", *tstats).selectExpr("*", *pvals)
    return row.selectExpr(f"inline(array({', '.join(parts)}))")


def tally(verdicts: DataFrame) -> DataFrame:
    """Count of hypotheses per verdict (H6)."""
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
