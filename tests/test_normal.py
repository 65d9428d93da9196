"""Regression from moments: the same as a fit over rows, and as MLlib fold by fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from envseries.operators import models, normal


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) * [1.0, 50.0, 0.01] + [1e6, -3.0, 0.0]
    y = 2.0 + (x - [1e6, -3.0, 0.0]) @ [3.0, -0.2, 100.0] + rng.normal(size=400)
    rows = [(i, *map(float, r), 7.0, float(t)) for i, (r, t) in enumerate(zip(x, y))]
    rows += [(1000, None, 1.0, 1.0, 7.0, 1.0), (1001, 1.0, 1.0, 1.0, 7.0, None)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, flat double, y double").repartition(5), x, y


@pytest.mark.parametrize("alpha", [0.0, 1.0, 25.0])
def test_fit_equals_rows(frame, alpha):
    df, x, y = frame
    m = normal.moments(df, "y", ["a", "b", "c", "flat"])[0]
    coef, intercept = normal.fit(m, alpha)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    np.testing.assert_allclose(coef, [*w, 0.0], rtol=1e-7)
    assert intercept == pytest.approx(y.mean() - w @ x.mean(0), rel=1e-9)
    pred = x @ w + y.mean() - w @ x.mean(0)
    assert normal.r2(m, coef, intercept) == pytest.approx(1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-7)
    out = normal.predict(df.filter("y IS NOT NULL AND a IS NOT NULL"), ["a", "b", "c", "flat"], coef, intercept).orderBy("k")
    np.testing.assert_allclose([r.prediction for r in out.collect()], pred, rtol=1e-6)


def test_moments_add_up(frame):
    df, _, _ = frame
    whole = normal.moments(df, "y", ["a", "b", "c"])[0]
    parts = normal.moments(df, "y", ["a", "b", "c"], F.col("k") % 7)
    both = sum(list(parts.values())[1:], list(parts.values())[0])
    assert both.n == whole.n and len(parts) == 7
    np.testing.assert_allclose(both.mean, whole.mean, rtol=1e-12)
    np.testing.assert_allclose(both.comoment, whole.comoment, rtol=1e-7, atol=1e-6)


@pytest.mark.parametrize("kind", ["linear", "ridge"])
def test_cross_validation_equals_one_fit_per_fold(frame, kind):
    df, _, _ = frame
    train = df.na.drop().select("k", "b", "c", "y")
    quick = models.cv_r2(train, "y", ["b", "c"], kind, "k", 4)
    slow = models.cv_r2_by_fits(train, "y", ["b", "c"], kind, "k", 4)
    np.testing.assert_allclose(quick[2], slow[2], rtol=1e-6)
    assert quick[:2] == pytest.approx(slow[:2], rel=1e-6)


def test_awkward_frames(spark, frame):
    none = spark.createDataFrame([], "k long, b double, y double")
    assert normal.moments(none, "y", ["b"]) == {}
    flat = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "b double, y double")
    m = normal.moments(flat, "y", ["b"])[0]
    coef, intercept = normal.fit(m)
    assert (coef[0], intercept) == pytest.approx((0.0, 5.0)) and np.isnan(normal.r2(m, coef, intercept))
    twice = spark.createDataFrame([(float(i), 2.0 * i, 3.0 * i + 1) for i in range(9)], "b double, c double, y double")
    m = normal.moments(twice, "y", ["b", "c"])[0]
    coef, intercept = normal.fit(m)  # collinear: the shortest solution, the same line
    assert normal.r2(m, coef, intercept) == pytest.approx(1.0) and intercept == pytest.approx(1.0)
