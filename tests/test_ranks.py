"""Ranks by range partitions, quantiles by narrowing, halo exchange: against pandas, and the shape of their plans."""

import datetime as dt
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from envseries.operators import correlation, distribution, quantile, ranks, scan, timeline

INF = float("inf")


def mixed_values(seed, n):
    """Narrow range, one very common value, ties, infinities, nulls."""
    draw = random.Random(seed)
    return [draw.choice([950.0, 950.0, 950.0, None, draw.uniform(920, 1060), round(draw.uniform(920, 1060), 1), -draw.random(), INF, -INF])
            for _ in range(n)]


def test_average_rank_equals_pandas(spark):
    rows = [(i, g, v) for g in ("a", "b", None) for i, v in enumerate(mixed_values(len(g or ""), 700))]
    df = spark.createDataFrame(rows, "i int, g string, v double").repartition(6)
    out = ranks.average_rank(df, "v", ["g"]).toPandas()
    want = pd.DataFrame(rows, columns=["i", "g", "v"])
    want["rank"] = want.groupby("g", dropna=False)["v"].rank()
    m = out.merge(want, on=["i", "g"], suffixes=("", "_want"))
    assert len(m) == len(rows)
    np.testing.assert_array_equal(m["rank"], m["rank_want"])


def test_range_partitions_are_even(spark):
    """A million values of a narrow range: no task holds more than twice the mean, none of them a whole group."""
    df = spark.range(1_000_000).selectExpr("920 + 140 * rand(5) AS v")
    c = ranks.cumulative_counts(df, "v")
    sizes = [r["count"] for r in c.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == c.count() and max(sizes) <= 2 * sum(sizes) / 8
    assert c.agg(F.max(F.col("_before") + F.col("_c"))).first()[0] == 1_000_000


@pytest.mark.parametrize("page, accuracy", [(10_000, 1000), (40, 100), (5, 1000)])
def test_quantiles_by_narrowing_equal_numpy(spark, page, accuracy):
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    data = {"narrow": mixed_values(1, 4000), "few": [3.0, None, 1.0], "one": [7.0] * 900, "none": [None] * 5,
            # very many rare values between two very common ones: the brackets can't close in on the middle
            "walls": [0.0] * 2000 + [1.0] * 2000 + [0.5 + i / 10_000 for i in range(101)], None: [float(i % 37) for i in range(2000)]}
    rows = [(g, v) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(r.g, r.prob): (r.value, r.n) for r in quantile.rank_quantiles(df, "v", probs, ["g"], page=page, accuracy=accuracy).collect()}
    for g, vs in data.items():
        known = sorted(v for v in vs if v is not None)
        for p in probs:
            if not known:
                assert (g, p) not in got
                continue
            h = p * (len(known) - 1)
            lo, hi = known[int(np.floor(h))], known[int(np.ceil(h))]
            want = lo if lo == hi else (np.ceil(h) - h) * lo + (h - np.floor(h)) * hi
            assert got[g, p] == (pytest.approx(want, rel=1e-12), len(known)), (g, p)


def test_quantiles_buffer_no_values(spark):
    df = spark.range(20_000).selectExpr("id % 3 AS g", "rand(1) AS v")
    plan = quantile.rank_quantiles(df, "v", [0.5], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "Window" not in plan and "CartesianProduct" not in plan
    box = distribution.box_stats(df, "v", ["g"], method="rank")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in box and "Range (" not in box  # everything from the counts, the input isn't read again


def test_box_stats_by_counts_equal_the_aggregate(spark):
    rows = [(g, v) for g in ("x", "y") for v in mixed_values(ord(g), 800) if v not in (INF, -INF)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for by in (["g"], []):
        one = distribution.box_stats(df, "v", by)
        other = distribution.box_stats(df, "v", by, method="rank").select(one.columns)
        for x, y in zip(sorted(map(tuple, one.collect())), sorted(map(tuple, other.collect())), strict=True):
            assert x[:len(by)] == y[:len(by)] and x[len(by):] == pytest.approx(y[len(by):], rel=1e-12)


def hours(spark, seed, n=400):
    """Two series (one without a name), gaps of days, so that buckets hold from one row to many."""
    draw = random.Random(seed)
    rows, at = [], 0
    for s in ("s", None):
        for _ in range(n):
            at += draw.choice([1, 1, 1, 2, 30, 100])
            rows.append((s, dt.datetime(2023, 1, 1) + dt.timedelta(hours=at), draw.choice([None, draw.gauss(0, 1)])))
    return rows, spark.createDataFrame(rows, "s string, ts timestamp_ntz, v double").repartition(7)


def test_lags_and_rolling_rows_equal_pandas(spark):
    rows, df = hours(spark, 3)
    out = scan.lags(df, ["s"], "ts", {"l0": ("v", 0), "l1": ("v", 1), "l5": ("v", 5), "l40": ("v", 40)}, bucket="day")
    out = scan.rolling_rows(out, ["s"], "ts", "v", 3, 2, 2, "roll", bucket="day").toPandas().sort_values("ts", ignore_index=True)
    want = pd.DataFrame(rows, columns=["s", "ts", "v"]).sort_values("ts", ignore_index=True)
    by = want.groupby("s", dropna=False)["v"]
    for k in (0, 1, 5, 40):
        np.testing.assert_array_equal(out[f"l{k}"], by.shift(k))
    v = want["v"].to_numpy(dtype=float)
    name = want["s"].isna().to_numpy()
    for i in range(len(v)):
        near = [v[j] for j in range(max(i - 3, 0), min(i + 3, len(v))) if name[j] == name[i] and not np.isnan(v[j])]
        assert out["roll"][i] == pytest.approx(np.mean(near), nan_ok=True) if len(near) >= 2 else np.isnan(out["roll"][i])


def test_rows_are_exchanged_once(spark):
    """Without broadcast joins: one exchange of the rows; what else is exchanged has a row per bucket."""
    _, df = hours(spark, 4, 50)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (scan.lags(df, ["s"], "ts", {"a": ("v", 1), "b": ("v", 6)}), scan.interpolate(df, ["s"], "ts", ["v"]),
                    scan.rolling_rows(df, ["s"], "ts", "v", 3, 3)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            by_bucket = re.findall(r"(?<!Reused)Exchange hashpartitioning\(_key#\d+, \d+\)", plan)
            rows = [x for x in re.findall(r"Exchange hashpartitioning\(_key#\d+, 8\), ENSURE_REQUIREMENTS", plan)]
            scans = len(re.findall(r"hashpartitioning\(_key", plan)) - len(re.findall(r"ReusedExchange", plan))
            assert by_bucket and rows and scans <= 2, plan  # the rows, and the bucket table on its way back
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rolling_centered_is_the_spine_rolling_mean(spark):
    days = [dt.datetime(2022, 11, 20) + dt.timedelta(days=i) for i in range(83)]
    v = [None if i % 5 == 1 or 20 < i < 27 else float(i * i % 17) for i in range(len(days))]
    df = spark.createDataFrame(list(zip(days, v)), "ts timestamp_ntz, v double")
    out = timeline.rolling_centered(df, "v").toPandas().sort_values("ts", ignore_index=True)
    want = pd.Series(v, dtype=float).rolling(7, center=True, min_periods=4).mean()
    np.testing.assert_allclose(out["rolling"], want, rtol=1e-12)


def test_lag_correlation_equals_pandas(spark):
    draw = random.Random(8)
    n = 300
    x = [None if draw.random() < 0.1 else round(draw.gauss(0, 1), 1) for _ in range(n)]
    y = [None if draw.random() < 0.1 else round((x[i - 2] or 0) + draw.gauss(0, 1), 1) for i in range(n)]
    ts = [dt.datetime(2023, 1, 1) + dt.timedelta(hours=3 * i) for i in range(n)]
    df = spark.createDataFrame(list(zip(["a"] * n, ts, x, y)), "s string, ts timestamp_ntz, x double, y double").repartition(3)
    p = pd.DataFrame({"x": x, "y": y}).dropna().reset_index(drop=True)
    one = {r.lag: r for r in correlation.lag_correlation(df, "x", "y", 6, bucket="day").collect()}
    by_series = {r.lag: r for r in correlation.lag_correlation(df, "x", "y", 6, ["s"], bucket="day").collect()}
    quick = {r.lag: r for r in correlation.lag_correlation(df, "x", "y", 6, bucket="day", spearman=False).collect()}
    for k in range(7):
        a, b = p["x"].shift(k)[k:], p["y"][k:]
        for got in (one[k], by_series[k]):
            assert got.n == len(p) - k
            assert got.pearson == pytest.approx(a.corr(b), rel=1e-9)
            assert got.spearman == pytest.approx(a.rank().corr(b.rank()), rel=1e-9)
        assert quick[k].pearson == pytest.approx(one[k].pearson)
    few = df.filter("x IS NOT NULL AND y IS NOT NULL").orderBy("ts").limit(3)
    assert sorted(r.lag for r in correlation.lag_correlation(few, "x", "y", 6).collect()) == [0, 1, 2]
