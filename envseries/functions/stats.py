"""Statistical aggregate expressions (Pearson, t from r).

Aggregates are plain Spark aggregate expressions so that they run with
partial (map-side) aggregation.  ANSI mode is on in Spark 4, where ``corr``
on a constant column raises; the Pearson expression below uses
``try_divide`` and returns null instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pair_complete(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """Both inputs nulled where either is null (pairwise-complete rows)."""
    x, y = _c(a), _c(b)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def pearson(a: str | Column, b: str | Column) -> Column:
    """Pearson r over pairwise-complete rows; null for constant input or n < 2."""
    if isinstance(a, str) and isinstance(b, str):
        # SQL text: one parse instead of a dozen gateway calls per pair
        x, y = f"`{a}`", f"`{b}`"
        both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
        xa, ya = f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END"
        return F.expr(f"try_divide(covar_samp({xa}, {ya}), stddev_samp({xa}) * stddev_samp({ya}))")
    x, y = pair_complete(a, b)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def pair_count(a: str | Column, b: str | Column) -> Column:
    x, _ = pair_complete(a, b)
    return F.count(x)


def t_from_r(r: Column, n: Column) -> Column:
    """t statistic of a correlation coefficient with n pairs."""
    return F.try_divide(r * F.sqrt((n - 2).cast("double")), F.sqrt(1 - r * r))


def circular_mean(degrees: str) -> Column:
    """Mean direction in [0, 360) of a column of degrees, as the direction of the mean unit vector.

    Null without values, and where the vectors cancel out (below 1e-9).
    """
    y, x = f"avg(sin(radians(`{degrees}`)))", f"avg(cos(radians(`{degrees}`)))"
    return F.expr(f"CASE WHEN {x} * {x} + {y} * {y} > 1e-18D THEN pmod(degrees(atan2({y}, {x})), 360.0D) END")
