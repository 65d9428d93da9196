"""The hourly reshape (G1 / G2) on an unbounded source.

The reference has no streaming; this is the same period-mean pivot applied
to a Structured Streaming source, so a feed can be reshaped incrementally:
event-time windows of one hour, a watermark bounding state for late rows,
conditional aggregation (pivot is not available on streams) and an append
sink that emits each hour once it can no longer change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reshape import safe_name


def long_schema(extra: Sequence[str] = ()) -> T.StructType:
    fields = [T.StructField("ts", T.TimestampType()), T.StructField("parameter", T.StringType()),
              T.StructField("value", T.DoubleType())]
    return T.StructType(fields + [T.StructField(e, T.StringType()) for e in extra])


def hourly_wide_stream(stream: DataFrame, params: Sequence[str], *, series: Sequence[str] = (),
                       ts: str = "ts", parameter: str = "parameter", value: str = "value",
                       watermark: str = "2 hours", names: Sequence[str] | None = None) -> DataFrame:
    """Streaming long -> wide hourly means; one row per (series, hour).

    State is bounded by the watermark: an hour is finalised (and dropped from
    state) once event time has passed its end plus ``watermark``.
    """
    names = list(names) if names is not None else [safe_name(p) for p in params]
    t = F.col(ts).cast("timestamp")
    s = (stream.filter(F.col(parameter).isin(list(params)))
         .withColumn("_et", t)
         .withWatermark("_et", watermark))
    aggs = [F.avg(F.when(F.col(parameter) == p, F.col(value))).alias(n) for p, n in zip(params, names)]
    g = s.groupBy(*series, F.window("_et", "1 hour").alias("_w")).agg(*aggs)
    return g.select(*series, F.col("_w.start").cast("timestamp_ntz").alias("ts"), *names)


def start_hourly_sink(wide: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """Append finalised hours to a Parquet table; the checkpoint folder (on
    shared storage) makes the query restartable with exactly-once output."""
    w = (wide.writeStream.format("parquet").outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="1 minute")
    return w.start()
