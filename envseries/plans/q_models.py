"""Registered queries: regression models.

Splits by key hash and the forest have no SQL twin (rows-only checks); the
``_sql`` queries split by the hour's number, which both engines know.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distribution, models, normal
from . import sqlbase as S
from . import standins as D
from .registry import query
from .sqlbase import R

TARGET = "click"
KEY = "ts"
FEATURES = ["purchase", "signup", "wind_direction", "sunshine_h", "hour", "weekday", "month", "is_weekend",
            "is_rush_hour", "inversion", "rain"]
KINDS = [("linear", "linear regression"), ("ridge", "ridge regression"), ("forest", "random forest")]


def _frames(spark, d):
    f = D.final_table(spark, d).withColumn("wind_direction", F.pmod(F.col("signup") * 10, F.lit(360.0)))
    # one reliable checkpoint (spark.checkpoint.dir) cuts the lineage: every
    # fit and fold reads the materialised model frame, not the whole plan
    m = models.model_frame(f, TARGET, FEATURES, KEY).checkpoint(eager=True)
    is_test = models.split_flag(KEY)
    return m.filter(~is_test), m.filter(is_test)


def _coef_frame(spark, rows):
    return spark.createDataFrame(rows, "feature string, coefficient double")


@query("linear_model", "M1 M2 M3 M4")
def linear_model(spark, d):
    train, test = _frames(spark, d)
    model, _, names = models.fit_predict(train, test, TARGET, FEATURES, "linear")
    return _coef_frame(spark, models.coefficients(model, FEATURES))


@query("ridge_model", "M5")
def ridge_model(spark, d):
    train, test = _frames(spark, d)
    model, _, names = models.fit_predict(train, test, TARGET, FEATURES, "ridge")
    return _coef_frame(spark, models.coefficients(model, FEATURES))


@query("forest_importance", "M6 M10 S1 S2")
def forest_importance(spark, d):
    train, test = _frames(spark, d)
    model, _, _ = models.fit_predict(train, test, TARGET, FEATURES, "forest")
    rows = models.importances(model, FEATURES)
    return spark.createDataFrame(rows, "feature string, importance double")


@query("model_metrics", "M7 M9 S3")
def model_metrics(spark, d):
    train, test = _frames(spark, d)
    out = None
    for kind, label in KINDS:
        _, pred, _ = models.fit_predict(train, test, TARGET, FEATURES, kind)
        m = models.regression_metrics(pred, TARGET, label)
        out = m if out is None else out.unionByName(m)
    best = out.agg(F.max_by("model", "r2").alias("_best"))
    return out.crossJoin(best).withColumn("best", F.col("model") == F.col("_best")).drop("_best")


@query("cv_scores", "M8")
def cv_scores(spark, d):
    train, _ = _frames(spark, d)
    rows = []
    for kind, label in KINDS:
        mean, std, _ = models.cv_r2(train, TARGET, FEATURES, kind, KEY, 5)
        rows.append((label, mean, std))
    return spark.createDataFrame(rows, "model string, cv_r2_mean double, cv_r2_std double")


@query("residual_histogram", "M11 G18")
def residual_histogram(spark, d):
    train, test = _frames(spark, d)
    _, pred, _ = models.fit_predict(train, test, TARGET, FEATURES, "linear")
    res = pred.select((F.col(TARGET) - F.col("prediction")).alias("residual"))
    return distribution.histogram(res, "residual", 60)


# ---------------------------------------------------------------- one feature, with SQL twins

#: Every fifth hour tests; folds by the hour's number.
_HOUR_SQL = "CAST(epoch(ts) AS BIGINT) // 3600"
_PAIRS_SQL = f"SELECT ts, signup AS x, click AS y, {_HOUR_SQL} % 5 AS fold FROM ({S.HOURLY}) WHERE signup IS NOT NULL AND click IS NOT NULL"


def _pairs(spark, d):
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    return (D.hourly_wide(spark, d).select("ts", F.col("signup").alias("x"), F.col("click").alias("y"), (hour % 5).cast("int").alias("fold"))
            .na.drop(subset=["x", "y"]))


@query("ols_one_feature", "M4", f"""
SELECT {R('regr_slope(y, x)')} AS slope, {R('regr_intercept(y, x)')} AS intercept, {R('regr_r2(y, x)')} AS r2, count(*) AS n
FROM ({_PAIRS_SQL})""")
def ols_one_feature(spark, d):
    m = normal.moments(_pairs(spark, d), "y", ["x"])[0]
    coef, intercept = normal.fit(m)
    row = (float(coef[0]), intercept, normal.r2(m, coef, intercept), m.n)
    return spark.createDataFrame([row], "slope double, intercept double, r2 double, n long")


@query("cv_one_feature", "M8", f"""
WITH p AS ({_PAIRS_SQL}),
f AS (SELECT k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p, (SELECT DISTINCT fold FROM p) k
      WHERE p.fold <> k.fold GROUP BY k.fold),
s AS (SELECT fold, 1 - sum((y - a - b * x) * (y - a - b * x)) / (var_pop(y) * count(*)) AS r2 FROM p JOIN f USING (fold) GROUP BY fold)
SELECT {R('avg(r2)')} AS cv_r2_mean, {R('stddev_pop(r2)')} AS cv_r2_std FROM s""")
def cv_one_feature(spark, d):
    mean, std, _ = normal.cross_validate(normal.moments(_pairs(spark, d), "y", ["x"], F.col("fold")))
    return spark.createDataFrame([(mean, std)], "cv_r2_mean double, cv_r2_std double")


_PRED_SQL = f"""
WITH p AS ({_PAIRS_SQL}),
c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m FROM p WHERE fold <> 0),
t AS (SELECT 'line' AS model, y, a + b * x AS prediction FROM p, c WHERE fold = 0
      UNION ALL SELECT 'mean', y, m FROM p, c WHERE fold = 0)"""


def _predictions(spark, d):
    """(model, y, prediction) of the test hours, stored: a line on signup, and the mean."""
    p = _pairs(spark, d)
    m = normal.moments(p.filter("fold <> 0"), "y", ["x"])[0]
    test = p.filter("fold = 0")
    line = normal.predict(test, ["x"], *normal.fit(m))
    mean = normal.predict(test, [], [], float(m.mean[-1]))
    both = line.select(F.lit("line").alias("model"), "y", "prediction").union(mean.select(F.lit("mean"), "y", "prediction"))
    return both.checkpoint(eager=True)


@query("model_metrics_sql", "M7 M9 S3", _PRED_SQL + f""",
e AS (SELECT model, avg(abs(y - prediction)) AS mae, sqrt(avg((y - prediction) * (y - prediction))) AS rmse,
             1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*)) AS r2, count(*) AS n_test FROM t GROUP BY model)
SELECT model, {R('mae')} AS mae, {R('rmse')} AS rmse, {R('r2')} AS r2, n_test,
       model = (SELECT arg_max(model, r2) FROM e) AS best FROM e""")
def model_metrics_sql(spark, d):
    p = _predictions(spark, d)
    out = [models.regression_metrics(p.filter(F.col("model") == k), "y", k) for k in ("line", "mean")]
    both = out[0].unionByName(out[1])
    best = both.agg(F.max_by("model", "r2").alias("_best"))
    return both.crossJoin(F.broadcast(best)).withColumn("best", F.col("model") == F.col("_best")).drop("_best")


@query("residual_histogram_sql", "M11 G18", _PRED_SQL + f""",
d AS (SELECT y - prediction AS v FROM t WHERE model = 'line'),
r AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n_total, avg(v) AS mean, median(v) AS median FROM d),
b AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / 60)), 59) AS INTEGER) AS bin, count(*) AS n FROM d, r GROUP BY 1),
g AS (SELECT *, CAST(unnest(range(0, 60)) AS INTEGER) AS bin FROM r)
SELECT g.bin, {R('lo + (hi - lo) / 60 * g.bin')} AS bin_low, {R('lo + (hi - lo) / 60 * (g.bin + 1)')} AS bin_high,
       coalesce(b.n, 0) AS n, n_total, {R('mean')} AS mean, {R('median')} AS median FROM g LEFT JOIN b ON b.bin = g.bin""")
def residual_histogram_sql(spark, d):
    line = _predictions(spark, d).filter("model = 'line'")
    return distribution.histogram(line.select((F.col("y") - F.col("prediction")).alias("residual")), "residual", 60)
