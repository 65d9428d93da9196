"""Linear and ridge regression from moments: one scan, whatever the number of folds.

Counts, means and co-moments of features and target are one aggregate per
fold.  Moments of disjoint rows add up, so those of a training set are the
sum of the other folds', scaling included, and the error on a fold follows
from its own moments: cross-validation needs no fit over rows and no second
scan.  The driver holds (features + 1)^2 numbers per fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """Rows, means and centred co-moments (sums) of the features and, last, the target."""

    n: int
    mean: np.ndarray
    comoment: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        step = other.mean - self.mean
        return Moments(n, self.mean + step * (other.n / n),
                       self.comoment + other.comoment + np.outer(step, step) * (self.n * other.n / n))


def moments(df: DataFrame, target: str, features: Sequence[str], fold: Column | None = None) -> dict[int, Moments]:
    """Moments of each fold (0 if none is given) over the rows without nulls, in one aggregate."""
    cols = [*features, target]
    size = len(cols)
    d = df.select((fold if fold is not None else F.lit(0)).cast("int").alias("_fold"),
                  *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)]).na.drop()
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    rows = d.groupBy("_fold").agg(F.expr("count(1) AS n"), *[F.expr(f"avg(_c{i}) AS a{i}") for i in range(size)],
                                  *[F.expr(f"covar_pop(_c{i}, _c{j}) AS c{i}_{j}") for i, j in pairs]).collect()
    out = {}
    for r in rows:
        cov = np.zeros((size, size))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        out[r["_fold"]] = Moments(r["n"], np.array([r[f"a{i}"] for i in range(size)]), cov * r["n"])
    return out


def fit(m: Moments, alpha: float = 0.0) -> tuple[np.ndarray, float]:
    """Coefficients and intercept on the given scale; the ridge penalty holds on population z-scores (M4, M5).

    Constant features get 0, and of equally good solutions the shortest (in z-scores) is taken.
    """
    xx, xy = m.comoment[:-1, :-1], m.comoment[:-1, -1]
    std = np.sqrt(np.diag(xx) / max(m.n, 1))
    live = std > 1e-12 * np.maximum(np.abs(m.mean[:-1]), 1e-300)
    scale = np.where(live, std, 1.0)
    gram = xx / np.outer(scale, scale) * np.outer(live, live) + alpha * np.eye(len(std))
    z = np.linalg.lstsq(gram, np.where(live, xy / scale, 0.0), rcond=1e-10)[0]
    coef = np.where(live, z / scale, 0.0)
    return coef, float(m.mean[-1] - coef @ m.mean[:-1])


def r2(m: Moments, coef: np.ndarray, intercept: float) -> float:
    """R^2 of a fitted line on the rows of ``m``; NaN if their target is constant."""
    residual = np.append(-coef, 1.0)
    bias = float(residual @ m.mean - intercept)
    total = float(m.comoment[-1, -1])
    return 1.0 - (float(residual @ m.comoment @ residual) + m.n * bias * bias) / total if total > 0 else float("nan")


def cross_validate(folds: dict[int, Moments], alpha: float = 0.0) -> tuple[float, float, list[float]]:
    """Mean and population deviation of the folds' R^2, each fitted on all the others, and the scores (M8)."""
    scores = []
    for k in sorted(folds):
        train = reduce(Moments.__add__, (m for j, m in folds.items() if j != k))
        scores.append(r2(folds[k], *fit(train, alpha)))
    return float(np.mean(scores)), float(np.std(scores)), scores


def predict(df: DataFrame, features: Sequence[str], coef: np.ndarray, intercept: float, out: str = "prediction") -> DataFrame:
    terms = [F.lit(intercept)] + [F.col(c).cast("double") * float(b) for c, b in zip(features, coef, strict=True)]
    return df.withColumn(out, reduce(Column.__add__, terms))
