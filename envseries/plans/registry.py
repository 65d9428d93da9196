"""Query registry: name -> (Spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Builder
    sql: str | None
    ops: str


REGISTRY: dict[str, Entry] = {}


def round_doubles(df: DataFrame, nd: int = 6) -> DataFrame:
    """Round every double column (top level) for order-insensitive comparison.

    A 5e-10 nudge moves values that sit exactly on a rounding tie off it, so
    both engines round them the same way whatever their summation order.
    """
    cols = []
    for f in df.schema.fields:
        name = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # same tie nudge as the SQL twins (sqlbase.R)
            cols.append(f"round({name} + 5e-10D, {nd}) AS {name}")
        else:
            cols.append(name)
    return df.selectExpr(*cols)


def query(name: str, ops: str, sql: str | None = None):
    """Register a query; its result gets doubles rounded to 6 decimals."""
    def deco(fn: Builder) -> Builder:
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        REGISTRY[name] = Entry(name, wrapped, sql, ops)
        return fn
    return deco
