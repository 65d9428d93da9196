"""Readers: long CSV measurements, nested hourly JSON feeds, Parquet tables.

Schemas are explicit (no inference on large inputs); NaN becomes null once,
here, so every downstream aggregate treats it as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecols import parse_naive_ts, parse_offset_ts


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace floating NaN with null in the given (default: all double) columns."""
    if cols is None:
        cols = [f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in cols})


def read_raw_csv(spark: SparkSession, path: str, *, sep: str = ",") -> DataFrame:
    """Every column of a CSV as text, as it stands (blanks around values included)."""
    return spark.read.option("header", True).option("sep", sep).csv(path)


def read_long_csv(spark: SparkSession, path: str, *, ts: str = "Datum",
                  parameter: str = "Parameter", value: str = "Wert",
                  ts_format: str = "yyyy-MM-dd'T'HH:mmZ",
                  extra: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """Long measurements ``(timestamp with offset, parameter, value)``.

    A leading UTF-8 BOM is stripped by Spark's CSV reader.  The timestamp is
    parsed with its offset, converted to UTC and returned zone-less as ``ts``;
    output columns: ``ts, parameter, value`` plus ``extra``.
    """
    # every column as string from the header (no inference pass); columns not
    # named here (station, unit, ...) are simply not selected
    return long_from_raw(read_raw_csv(spark, path, sep=sep), ts=ts, parameter=parameter, value=value,
                         ts_format=ts_format, extra=extra)


def long_from_raw(raw: DataFrame, *, ts: str = "Datum", parameter: str = "Parameter", value: str = "Wert",
                  ts_format: str = "yyyy-MM-dd'T'HH:mmZ", extra: Sequence[str] = ()) -> DataFrame:
    """The long measurements of ``read_long_csv`` from a frame (or stored copy) of text columns."""
    missing = [c for c in (ts, parameter, value, *extra) if c not in raw.columns]
    if missing:
        raise ValueError(f"columns {missing} not in {raw.columns}")
    out = raw.select(
        parse_offset_ts(F.col(ts)).alias("ts"),
        F.trim(F.col(parameter)).alias("parameter"),
        F.col(value).try_cast("double").alias("value"),
        *[F.col(e) for e in extra],
    )
    return nan_to_null(out, ["value"])


def read_wide_csv(spark: SparkSession, path: str, schema: T.StructType,
                  ts: str | None = None, ts_format: str | None = None) -> DataFrame:
    """Wide table with an explicit schema; the first column becomes ``timestamp``."""
    df = spark.read.option("header", True).schema(schema).csv(path)
    first = df.columns[0] if ts is None else ts
    if isinstance(schema[first].dataType, T.StringType):
        df = df.withColumn(first, parse_naive_ts(F.col(first), ts_format))
    return nan_to_null(df.withColumnRenamed(first, "timestamp"))


def hourly_feed_schema(variables: Sequence[str]) -> T.StructType:
    arrays = [T.StructField("time", T.ArrayType(T.StringType()))]
    arrays += [T.StructField(v, T.ArrayType(T.DoubleType())) for v in variables]
    return T.StructType([T.StructField("hourly", T.StructType(arrays))])


def read_hourly_feed(spark: SparkSession, path: str, variables: Sequence[str],
                     ts_name: str = "Datum", ts_format: str = "yyyy-MM-dd'T'HH:mm",
                     position: str | None = None) -> DataFrame:
    """Struct-of-parallel-arrays JSON (``hourly.time``, ``hourly.<var>``) -> one row per index.

    ``arrays_zip`` pads shorter arrays with null, so unequal null patterns
    stay aligned by index; ``time`` is renamed to ``ts_name``.  ``position``
    names a column for the index.
    """
    df = spark.read.schema(hourly_feed_schema(variables)).option("multiLine", True).json(path)
    zipped = F.arrays_zip(*[F.col(f"hourly.{n}").alias(n) for n in ["time", *variables]])
    rows = df.select(F.posexplode(zipped).alias("_i", "_row"))
    rows = rows.select(*([F.col("_i").alias(position)] if position else []), "_row.*")
    rows = rows.withColumn("time", parse_naive_ts(F.col("time"), ts_format))
    return nan_to_null(rows.withColumnRenamed("time", ts_name), list(variables))
