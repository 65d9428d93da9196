"""Statistics: correlations, ranks, p-values, hypothesis verdicts, models."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tables import SF01
from reference_t import t_two_sided_p, t_two_sided_p_exact
from envseries.functions.tdist import t_pvalue
from envseries.operators import correlation, hypothesis, models
from envseries.plans import standins as D


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    r = correlation.pearson_matrix(df, ["a", "b"]).first()
    assert r.r is None and r.n == 3


def test_average_rank_ties(spark):
    df = spark.createDataFrame([(v,) for v in [3.0, 1.0, 3.0, 2.0, None, 3.0]], "x double")
    out = sorted((r.x, r.rank) for r in correlation.average_rank(df, "x").collect() if r.x is not None)
    assert out == [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0)]


def test_average_rank_negative_and_wide_range(spark):
    vals = [-1e6, -3.5, -3.5, 0.0, 1e-9, 2.0, 2.0, 7e5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = sorted((r.x, r.rank) for r in correlation.average_rank(df, "x").collect())
    assert [g[1] for g in got] == [1.0, 2.5, 2.5, 4.0, 5.0, 6.5, 6.5, 8.0]


def test_spearman_ties_fixture(spark):
    rho = correlation.spearman(D.hourly_wide(spark, SF01), "click", "view").first().rho
    assert rho == pytest.approx(-0.02002306368400, abs=1e-12)


def test_pvalue_matches_reference_implementation(spark):
    cases = [(0.5, 3.0), (2.0, 10.0), (-3.5, 100.0), (10.0, 5.0), (2.5, 8757.0), (1.2, 1.0)]
    df = spark.createDataFrame(cases, "t double, d double")
    for r in df.select("t", "d", t_pvalue("t", "d").alias("p")).collect():
        assert r.p == pytest.approx(t_two_sided_p(r.t, r.d), rel=1e-9)
    # t with 1 degree of freedom is Cauchy: p = 1 - 2 atan(|t|) / pi
    assert t_two_sided_p(1.2, 1.0) == pytest.approx(1 - 2 * math.atan(1.2) / math.pi, rel=1e-12)


def test_pvalue_does_not_depend_on_the_degrees_of_freedom(spark):
    """Relative 1e-9 against 80-digit arithmetic, from one degree of freedom to 1e12 and into the far tail."""
    cases = [(t, d) for d in (1.0, 2.0, 3.0, 7.5, 19.0, 40.0, 41.0, 1e3, 1e6, 1e9, 1e12)
             for t in (1e-6, 0.5, 1.0, 1.2499, 1.25, 1.7, 2.0, 3.0, 5.0, 8.0)]
    df = spark.createDataFrame(cases, "t double, d double")
    for r in df.select("t", "d", t_pvalue("t", "d").alias("p")).collect():
        assert r.p == pytest.approx(t_two_sided_p_exact(r.t, r.d), rel=1e-9), (r.t, r.d)
    edge = spark.createDataFrame([(0.0, 5.0), (float("inf"), 5.0), (1.0, 0.0), (None, 5.0), (float("nan"), 5.0), (-2.0, 1e12)],
                                 "t double, d double").select(t_pvalue("t", "d").alias("p")).collect()
    assert [r.p for r in edge[:5]] == [1.0, 0.0, None, None, None]
    assert edge[5].p == pytest.approx(t_two_sided_p_exact(2.0, 1e12), rel=1e-9)


def test_verdict_order(spark):
    df = spark.createDataFrame([(-0.5, 0.5), (0.5, 0.5), (0.5, 0.01), (0.05, 0.01)], "e double, p double")
    v = [r.v for r in df.select(hypothesis.verdict("positive", F.col("e"), F.col("p"), F.col("e"), 0.10)
                                .alias("v")).collect()]
    assert v == ["not confirmed", "partly (not significant)", "confirmed", "partly (weak)"]


def test_group_test_skip_and_welch(spark):
    rng = np.random.default_rng(5)
    rows = [(0, float(x)) for x in rng.normal(10, 2, 50)] + [(1, float(x)) for x in rng.normal(11, 3, 40)]
    df = spark.createDataFrame(rows, "g int, v double")
    w = hypothesis.welch_test(df, "g", "v").first()
    a = np.array([v for g, v in rows if g == 0])
    b = np.array([v for g, v in rows if g == 1])
    se = a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b)
    assert w.t == pytest.approx((b.mean() - a.mean()) / math.sqrt(se), rel=1e-10)
    assert w.cohens_d == pytest.approx((b.mean() - a.mean()) / math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2))
    few = spark.createDataFrame(rows[:4] + rows[-10:], "g int, v double")
    hs = [hypothesis.Hypothesis("X", "positive", ("flag", "val"), "group")]
    out = hypothesis.evaluate(few, hs, {"flag": "g", "val": "v"}).first()
    assert out.verdict == "n/a"
    missing = hypothesis.evaluate(few, hs, {"flag": "g"}).first()
    assert missing.verdict == "n/a"


def test_quad_trend_recovers_parabola(spark):
    xs = np.linspace(-5, 5, 41)
    df = spark.createDataFrame([(float(x), float(2 - 0.5 * x + 0.25 * x * x)) for x in xs], "x double, y double")
    r = correlation.quad_trend(df, "x", "y").first()
    assert (r.c0, r.c1, r.c2) == pytest.approx((2, -0.5, 0.25), abs=1e-9)
    small = spark.createDataFrame([(1.0, 1.0)] * 10, "x double, y double")
    assert correlation.quad_trend(small, "x", "y").count() == 0


def test_ridge_closed_form(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(500, 3))
    y = X @ np.array([1.5, -2.0, 0.5]) + rng.normal(size=500)
    rows = [(i, float(y[i]), *map(float, X[i])) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, y double, a double, b double, c double")
    model, _, _ = models.fit_predict(df, df, "y", ["a", "b", "c"], "ridge")
    Z = (X - X.mean(0)) / X.std(0)
    expected = np.linalg.solve(Z.T @ Z + np.eye(3), Z.T @ (y - y.mean()))
    np.testing.assert_allclose(model.stages[-1].coefficients.toArray(), expected, rtol=1e-6)


def test_forest_learns_signal_and_is_repeatable(spark):
    rng = np.random.default_rng(2)
    X = rng.uniform(-1, 1, size=(400, 2))
    y = 3 * X[:, 0] ** 2 + X[:, 1] + rng.normal(scale=0.05, size=400)
    df = spark.createDataFrame([(i, float(y[i]), float(X[i, 0]), float(X[i, 1])) for i in range(400)],
                               "k long, y double, a double, b double")
    train = df.filter(~models.split_flag("k"))
    test = df.filter(models.split_flag("k"))
    _, p1, _ = models.fit_predict(train, test, "y", ["a", "b"], "forest")
    m1 = models.regression_metrics(p1, "y", "rf").first()
    _, p2, _ = models.fit_predict(train, test, "y", ["a", "b"], "forest")
    assert m1.r2 > 0.5
    assert models.regression_metrics(p2, "y", "rf").first().r2 == m1.r2


def test_rank_quantiles_equal_percentile(spark):
    from envseries.operators.quantile import rank_quantiles
    rng = np.random.default_rng(9)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 3000), np.round(rng.normal(0, 50, 3000), 1))]
    rows += [(3, 7.0)] + [(4, float(v)) for v in (-2.0, -2.0, 5.0, 1e6)]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r.g, r.prob): r.value for r in rank_quantiles(df, "v", probs, ["g"]).collect()}
    ref = df.groupBy("g").agg(F.percentile("v", probs).alias("q")).collect()
    for r in ref:
        for p, q in zip(probs, r.q):
            assert got[(r.g, p)] == pytest.approx(q, rel=1e-12, abs=1e-12)
    whole = {r.prob: r.value for r in rank_quantiles(df, "v", [0.5]).collect()}
    assert whole[0.5] == pytest.approx(df.agg(F.median("v")).first()[0])


@pytest.mark.parametrize("op", ["quantiles", "iqr", "winsorize", "flag"])
def test_rank_method_equals_percentile(spark, op):
    from envseries.operators import cleaning, features, profile
    h = D.hourly_wide(spark, SF01)
    cols = ["click", "error", "view"]

    def run(method):
        if op == "quantiles":
            out = profile.quantiles(h, cols, method=method)
        elif op == "iqr":
            out = profile.iqr_outliers(h, cols, method=method)
        elif op == "winsorize":
            out = cleaning.winsorize(h, cols, threshold_pct=0.0, method=method)
        else:
            out = features.joint_extreme_flag(h, "purchase", "signup", method=method)
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in out.collect())
    assert run("rank") == run("percentile")


def test_histogram_single_value_uses_numpy_range(spark):
    from envseries.operators import distribution
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    out = distribution.histogram(df, "v", 4).orderBy("bin").collect()
    counts, edges = np.histogram([3.0, 3.0], bins=4)
    assert [r.n for r in out] == list(counts)
    assert [r.bin_low for r in out] == pytest.approx(list(edges[:-1]))


def test_spearman_one_pass_equals_two_pass(spark):
    h = D.hourly_wide(spark, SF01)
    cols = ["click", "error", "view", "signup"]
    a = {(r.var_a, r.var_b): (r.rho, r.n) for r in correlation.spearman_matrix(h, cols).collect()}
    b = {(r.var_a, r.var_b): (r.rho, r.n) for r in correlation.spearman_matrix(h, cols, key=["ts"]).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][1] == b[k][1] and a[k][0] == pytest.approx(b[k][0], abs=1e-12)


def test_rank_medians_in_describe_and_group_stat(spark):
    from envseries.operators import distribution, profile
    h = D.hourly_wide(spark, SF01).withColumn("hour", F.hour("ts"))
    cols = ["click", "error", "view"]

    def rows(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rows(profile.describe(h, cols, method="rank")) == rows(profile.describe(h, cols))
    assert rows(distribution.group_stat(h, cols, ["hour"], "median", method="rank")) == \
        rows(distribution.group_stat(h, cols, ["hour"], "median"))


def test_histogram_rank_median(spark):
    from envseries.operators import distribution
    f = D.final_table(spark, SF01)

    def rows(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rows(distribution.histogram(f, "click", 50, ["inversion"], density=True, method="rank")) == \
        rows(distribution.histogram(f, "click", 50, ["inversion"], density=True))
