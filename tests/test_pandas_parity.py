"""Reference semantics against live pandas on random series, plus hot-key skew."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from envseries.operators import cleaning, reshape, scan, timeline


def _random_series(n, seed, null_share=0.3, block_nulls=True):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(50, 10, n), 2)
    mask = rng.random(n) < null_share
    if block_nulls:  # also long outages
        for start in rng.integers(0, n - 40, 5):
            mask[start:start + rng.integers(4, 40)] = True
    v = v.astype(object)
    v[mask] = None
    ts = [dt.datetime(2023, 1, 1) + dt.timedelta(hours=i) for i in range(n)]
    return ts, v


@pytest.mark.parametrize("seed", [1, 2])
def test_interpolate_and_runs_match_pandas(spark, seed):
    n = 3000
    ts, v = _random_series(n, seed)
    # one hot series holding most rows, plus small ones
    rows = [("hot", t, x) for t, x in zip(ts, v)] + [("small", t, x) for t, x in zip(ts[:50], v[:50])]
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz, x double")
    got = scan.interpolate(df, ["s"], "ts", ["x"], limit=3, bucket="day").filter("s = 'hot'").orderBy("ts")
    ref = pd.Series(pd.array(v, dtype="Float64")).astype(float).interpolate(limit=3, limit_direction="forward")
    np.testing.assert_allclose(np.array([r.x for r in got.collect()], dtype=float), ref.to_numpy(),
                               rtol=1e-12, equal_nan=True)
    # longest null run against pandas run-length logic
    miss = pd.Series([x is None for x in v]).astype(int)
    runs = miss.groupby((miss != miss.shift()).cumsum()).sum().max()
    got_run = scan.null_runs(df, ["s"], "ts", ["x"], bucket="day").filter("s = 'hot'").first().max_run
    assert got_run == runs


def test_daily_resample_matches_pandas(spark):
    ts, v = _random_series(24 * 40, 3, null_share=0.1, block_nulls=False)
    keep = [i for i in range(len(ts)) if not (240 <= i < 24 * 13)]  # a gap of whole days
    pdf = pd.DataFrame({"ts": [ts[i] for i in keep], "x": pd.array([v[i] for i in keep], dtype="Float64")})
    df = spark.createDataFrame([(ts[i], v[i]) for i in keep], "ts timestamp_ntz, x double")
    got = timeline.resample(df, {"s": F.sum("x"), "m": F.median("x")}, unit="day", zero_fill=["s"]).orderBy("ts")
    ref = pdf.set_index("ts")["x"].astype(float).resample("D").agg(["sum", "median"])
    out = got.collect()
    assert len(out) == len(ref)
    np.testing.assert_allclose([r.s for r in out], ref["sum"].to_numpy(), rtol=1e-9)
    np.testing.assert_allclose(np.array([r.m for r in out], dtype=float), ref["median"].to_numpy(),
                               rtol=1e-12, equal_nan=True)


def test_hot_key_dedupe_and_pivot(spark):
    rng = np.random.default_rng(4)
    n = 30000
    hot = dt.datetime(2024, 1, 1, 5)
    rows = []
    for i in range(n):
        t = hot if i % 3 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(rng.integers(0, 60 * 24 * 20)))
        rows.append((t, ["a", "b", "c"][i % 3 if i % 3 else int(rng.integers(0, 3))], float(rng.normal(10, 2))))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, parameter string, value double").repartition(8)
    wide = reshape.pivot_wide(df, params=["a", "b", "c"]).orderBy("ts").toPandas()
    pdf = pd.DataFrame(rows, columns=["ts", "parameter", "value"])
    pdf["ts"] = pdf["ts"].dt.floor("h")
    ref = pdf.pivot_table(index="ts", columns="parameter", values="value", aggfunc="mean")
    assert len(wide) == len(ref)
    np.testing.assert_allclose(wide[["a", "b", "c"]].to_numpy(dtype=float), ref[["a", "b", "c"]].to_numpy(),
                               rtol=1e-9, equal_nan=True)
    first = cleaning.dedupe_first(df, ["ts"])
    assert first.count() == pdf.assign(ts=[r[0] for r in rows])["ts"].nunique()
    hot_row = first.filter(F.col("ts") == hot).first()
    hot_ref = min((r for r in rows if r[0] == hot), key=lambda r: (r[1], r[2]))
    assert (hot_row.parameter, hot_row.value) == (hot_ref[1], hot_ref[2])
