"""Streaming hourly reshape equals the batch pivot once all hours are final."""

import os
import tempfile

from pyspark.sql import functions as F

from tables import SF001
from envseries.operators import reshape
from envseries.streaming.hourly import hourly_wide_stream, long_schema, start_hourly_sink

TYPES = ["click", "error", "purchase", "signup", "view"]


def test_stream_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="envseries-stream-")
    src = os.path.join(d, "in")
    ev = spark.read.parquet(f"{SF001}/events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("parameter"), "value")
    ev.repartition(4).write.parquet(src)
    # a far-future row advances the watermark so every real hour is final
    spark.createDataFrame([("2030-01-01 00:00:00", "click", 0.0)], "t string, parameter string, value double") \
        .select(F.to_timestamp("t").alias("ts"), "parameter", "value").write.mode("append").parquet(src)
    stream = spark.readStream.schema(long_schema()).parquet(src)
    q = start_hourly_sink(hourly_wide_stream(stream, TYPES), os.path.join(d, "out"), os.path.join(d, "ck"))
    q.awaitTermination(120)
    # availableNow emits windows closed by the watermark; a second run flushes the rest
    q = start_hourly_sink(hourly_wide_stream(stream, TYPES), os.path.join(d, "out"), os.path.join(d, "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(d, "out"))
    batch = reshape.pivot_wide(ev.withColumn("ts", F.col("ts").cast("timestamp_ntz")), params=TYPES, names=TYPES)
    def rounded(df):  # partial sums may be combined in another order
        return df.select("ts", *[F.round(c, 9).alias(c) for c in TYPES])
    assert got.count() == batch.count()
    assert rounded(got).exceptAll(rounded(batch)).count() == 0
