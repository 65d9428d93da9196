"""Regression models on the feature table with Spark MLlib.

Split, scaling, fitting, metrics and cross-validation are all distributed:
scaling statistics and metrics are aggregates, linear models use the
normal-equation solver (one pass of X'X aggregation), the forest uses
MLlib's distributed tree learning.  The driver only holds fitted
coefficients and the per-fold metric scalars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import normal
from .features import scale

PRED = "prediction"


def model_frame(df: DataFrame, target: str, features: Sequence[str], key: str) -> DataFrame:
    """Target, features and split key; rows with any null dropped (M1)."""
    cols = [key, target, *features]
    return df.select(*[F.col(c).cast("double").alias(c) if c not in (key,) else F.col(c) for c in cols]) \
             .na.drop(subset=[target, *features])


def split_flag(key: str, test_pct: int = 20, seed: int = 42) -> Column:
    """Deterministic 80/20 split by hashing the row key (M2): reproducible
    under any partitioning and after executor loss (no random sampling)."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100)) < test_pct


def fold_of(key: str, folds: int = 5, seed: int = 7) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int")


def _zscored(train: DataFrame, other: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Population z-scores fitted on train only, applied to both (M3)."""
    z_train = scale(train, features, ("std",), impute_zero=False, fit_on=train)
    z_other = scale(other, features, ("std",), impute_zero=False, fit_on=train)
    return z_train, z_other, [f"{c}_std" for c in features]


def _estimator(kind: str, target: str, n_train: int | None = None, y_std: float | None = None,
               alpha: float = 1.0, seed: int = 42):
    if kind == "linear":
        return LinearRegression(featuresCol="features", labelCol=target, regParam=0.0, solver="normal",
                                standardization=False)
    if kind == "ridge":
        # sklearn's Ridge(alpha) on population z-scores equals MLlib's L2 with
        # regParam = alpha * std_pop(y) / n and no internal standardisation.
        reg = alpha * (y_std or 0.0) / max(n_train or 1, 1)
        return LinearRegression(featuresCol="features", labelCol=target, regParam=reg, elasticNetParam=0.0,
                                solver="normal", standardization=False)
    if kind == "forest":
        return RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=100, maxDepth=10,
                                     featureSubsetStrategy="all", seed=seed)
    raise ValueError(kind)


def fit_predict(train: DataFrame, test: DataFrame, target: str, features: Sequence[str], kind: str):
    """Fit on train (scaler fitted on train only), predict test.

    Returns ``(pipeline_model, predictions, scaled_feature_names)``.
    """
    z_train, z_test, zcols = _zscored(train, test, features)
    n_train, y_std = None, None
    if kind == "ridge":
        row = z_train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("s")).first()
        n_train, y_std = int(row["n"]), float(row["s"] or 0.0)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=zcols, outputCol="features"),
                            _estimator(kind, target, n_train, y_std)])
    model = pipe.fit(z_train)
    return model, model.transform(z_test), zcols


def regression_metrics(pred: DataFrame, target: str, label: str) -> DataFrame:
    """MAE, RMSE and R^2 of a prediction frame as one aggregate row (M7)."""
    err = F.col(target) - F.col(PRED)
    row = pred.agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
                   F.sum(err * err).alias("_sse"), F.var_pop(target).alias("_var"),
                   F.count(F.lit(1)).alias("n_test"))
    r2 = 1 - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n_test"))
    return row.select(F.lit(label).alias("model"), "mae", "rmse", r2.alias("r2"), "n_test")


def coefficients(model, names: Sequence[str]) -> list[tuple[str, float]]:
    """Linear coefficients (feature, coefficient) plus the intercept."""
    lr = model.stages[-1]
    rows = [(n, float(v)) for n, v in zip(names, lr.coefficients.toArray())]
    rows.append(("(intercept)", float(lr.intercept)))
    return rows


def importances(model, names: Sequence[str]) -> list[tuple[str, float]]:
    """Forest feature importances (M10), largest first."""
    imp = model.stages[-1].featureImportances.toArray()
    return sorted(((n, float(v)) for n, v in zip(names, imp)), key=lambda x: (-x[1], x[0]))


def cv_r2(train: DataFrame, target: str, features: Sequence[str], kind: str, key: str,
          folds: int = 5) -> tuple[float, float, list[float]]:
    """k-fold R^2 on the training set: mean and population std (M8).

    Folds come from a key hash (deterministic).  Linear and ridge scores
    follow from the folds' moments, one scan for all (``normal``); the forest
    is one distributed fit per fold.
    """
    if kind in ("linear", "ridge"):
        found = normal.moments(train, target, features, fold_of(key, folds))
        return normal.cross_validate(found, 1.0 if kind == "ridge" else 0.0)
    return cv_r2_by_fits(train, target, features, kind, key, folds)


def cv_r2_by_fits(train: DataFrame, target: str, features: Sequence[str], kind: str, key: str,
                  folds: int = 5) -> tuple[float, float, list[float]]:
    """The same by one fit per fold, for any kind of model."""
    t = train.withColumn("_fold", fold_of(key, folds))
    scores = []
    for k in range(folds):
        tr = t.filter(F.col("_fold") != k).drop("_fold")
        va = t.filter(F.col("_fold") == k).drop("_fold")
        _, pred, _ = fit_predict(tr, va, target, features, kind)
        r2 = regression_metrics(pred, target, kind).first()["r2"]
        scores.append(float("nan") if r2 is None else float(r2))  # undefined on a constant fold
    mean = sum(scores) / len(scores)
    std = (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5
    return mean, std, scores
