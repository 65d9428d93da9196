"""Binning and flag expressions with the reference's edge semantics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Category edges and labels used by the reference.
TEMP_EDGES = [-30, 0, 10, 20, 30, 50]
TEMP_LABELS = ["Frost", "Kalt", "Mild", "Warm", "Heiss"]
WIND_EDGES = [0, 5, 20, 40, 300]
WIND_LABELS = ["Windstill", "Leicht", "Mässig", "Stark"]


def right_closed_bins(c: str | Column, edges: Sequence[float], labels: Sequence[str],
                      include_lowest: bool = False) -> Column:
    """Label of the bin ``(e[i], e[i+1]]``; outside (or on the lowest edge) -> null."""
    x = _c(c)
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = (x > lo) & (x <= hi)
        if include_lowest and i == 0:
            cond = (x >= lo) & (x <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def right_closed_bins_sql(c: str, edges: Sequence[float], labels: Sequence[str],
                          include_lowest: bool = False) -> str:
    """SQL text of ``right_closed_bins`` for column ``c``."""
    x = f"`{c}`"
    parts = []
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        op = ">=" if include_lowest and i == 0 else ">"
        parts.append(f"WHEN {x} {op} {lo} AND {x} <= {hi} THEN '{label}'")
    return f"CASE {' '.join(parts)} END"


def sector(direction: str | Column, width: float = 22.5, n: int = 16) -> Column:
    """Sector index of a direction in degrees: ``[0, w]`` -> 0, ``(w, 2w]`` -> 1, ...

    The direction is first reduced with ``pmod`` to [0, 360).
    """
    d = F.pmod(_c(direction).cast("double"), F.lit(360.0))
    return F.when(d == 0, 0).otherwise(F.least(F.ceil(d / width) - 1, F.lit(n - 1))).cast("int")


def flag(cond: Column) -> Column:
    """Boolean condition as 0/1 int; null counts as false (pandas semantics)."""
    return F.coalesce(cond, F.lit(False)).cast("int")
