"""Statistics of a series on its rows, whatever the number of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, table: DataFrame, series: Sequence[str]) -> DataFrame:
    """Each row of ``df`` with the columns of the row of ``table`` that has its series keys; null keys are equal.

    Without ``series`` the table is one row and broadcast.  The keys are
    compared as one struct, which is never null itself: a plain equality that
    AQE can split where one series holds much of the rows.
    """
    if not series:
        return df.crossJoin(F.broadcast(table))
    own = F.struct(*[F.col(s).alias(s) for s in series])
    left = df.withColumn("_series", own)
    right = table.withColumn("_series", own).drop(*series)
    return left.join(right, "_series").drop("_series")
