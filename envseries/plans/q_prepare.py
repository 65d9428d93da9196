"""Registered queries: reshape, profile, timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import circular_mean
from ..functions.timecols import date_label, floor_to, localize, month_label
from ..functions.units import LIMITS as HEALTH_LIMITS
from ..functions.units import unit_of
from ..operators import profile, reshape, scan, timeline, zones
from . import sqlbase as S
from . import standins as D
from .registry import query
from .sqlbase import R

TYPES = D.EVENT_TYPES


def _each(fmt: str, cols=TYPES, sep: str = ", ") -> str:
    return sep.join(fmt.format(c=c) for c in cols)


# ---------------------------------------------------------------- reshape

@query("hourly_mean", "T4 G1 P2", f"""
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, event_type AS parameter,
       {R('avg(value)')} AS value_mean, count(value) AS n
FROM events WHERE event_type IN ({_each("'{c}'")}) GROUP BY 1, 2""")
def hourly_mean(spark, d):
    return reshape.period_mean(D.events_long(spark, d), params=TYPES)


@query("hourly_wide", "G2 P2 P1", f"SELECT ts, {_each(R('{c}') + ' AS {c}')} FROM ({S.HOURLY})")
def hourly_wide(spark, d):
    return D.hourly_wide(spark, d)


@query("hourly_join", "J1", f"""
SELECT ts, {_each(R('{c}') + ' AS {c}', ['click', 'error', 'view', 'purchase', 'signup'])} FROM ({S.JOINED})""")
def hourly_join(spark, d):
    return D.joined(spark, d)


@query("join_quality", "J2", f"""
WITH c AS (SELECT (SELECT count(*) FROM ({S.AIR_SQL})) AS n_left,
                  (SELECT count(*) FROM ({S.WEATHER_SQL})) AS n_right,
                  (SELECT count(*) FROM ({S.JOINED})) AS n_joined)
SELECT n_left, n_right, n_joined, {R('n_joined * 100.0 / greatest(n_left, n_right)')} AS match_pct,
       n_left - n_joined AS lost_left, n_right - n_joined AS lost_right,
       coalesce(n_joined * 100.0 / greatest(n_left, n_right) < 80, false) AS warn FROM c""")
def join_quality(spark, d):
    from ..operators.quality import join_quality as jq
    return jq(D.air_hourly(spark, d), D.weather_hourly(spark, d), ["ts"])


@query("time_overlap", "T7 T11", f"""
WITH a AS ({S.AIR_SQL}), w AS ({S.WEATHER_SQL}),
win AS (SELECT greatest((SELECT min(ts) FROM a), (SELECT min(ts) FROM w)) AS "start",
               least((SELECT max(ts) FROM a), (SELECT max(ts) FROM w)) AS "end")
SELECT win."start", win."end",
       (SELECT count(*) FROM a, win WHERE a.ts BETWEEN win."start" AND win."end") AS n_left,
       (SELECT count(*) FROM w, win WHERE w.ts BETWEEN win."start" AND win."end") AS n_right
FROM win""")
def time_overlap(spark, d):
    win, a, b = timeline.overlap_filter(D.air_hourly(spark, d), D.weather_hourly(spark, d))
    return win.crossJoin(a.agg(F.count(F.lit(1)).alias("n_left"))) \
              .crossJoin(b.agg(F.count(F.lit(1)).alias("n_right")))


@query("observed_range", "T11", """
SELECT event_type AS parameter, min(ts) AS ts_min, max(ts) AS ts_max, count(*) AS n_rows
FROM events GROUP BY 1""")
def observed_range(spark, d):
    return timeline.observed_range(D.events_long(spark, d), ["parameter"], "ts")


# ---------------------------------------------------------------- profile

# Schemas of the catalogued driver tables (for the SQL twin).
CATALOG_TABLES = {
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}
LICENCE = "synthetic test data"


def _catalog_sql() -> str:
    parts = []
    for t, cols in CATALOG_TABLES.items():
        nulls = " + ".join(f"(count(*) - count({c}))" for c in cols)
        parts.append(f"SELECT '{t}' AS source, count(*) AS n_rows, CAST({len(cols)} AS BIGINT) AS n_columns, "
                     f"CAST({nulls} AS BIGINT) AS n_null_cells, '{LICENCE}' AS licence, "
                     f"'{t}.parquet' AS url FROM {t}")
    return " UNION ALL ".join(parts)


@query("source_catalog", "A9", _catalog_sql())
def source_catalog(spark, d):
    entries = [(t, D.table(spark, d, t), LICENCE, f"{t}.parquet") for t in CATALOG_TABLES]
    return profile.source_catalog(entries)


@query("null_profile", "G3", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, "
    f"{R(f'(count(*) - count({c})) * 100.0 / count(*)')} AS null_pct FROM ({S.HOURLY})) WHERE n_null > 0"
    for c in TYPES))
def null_profile(spark, d):
    return profile.null_profile(D.hourly_wide(spark, d), TYPES)


@query("table_null_share", "G4", f"""
SELECT n_rows, n_null_cells, n_rows * 5 AS n_cells, {R('n_null_cells * 100.0 / (n_rows * 5)')} AS null_pct,
       coalesce(n_null_cells * 100.0 / (n_rows * 5) > 20, false) AS warn
FROM (SELECT count(*) AS n_rows, CAST({_each('(count(*) - count({c}))', sep=' + ')} AS BIGINT) AS n_null_cells
      FROM ({S.HOURLY}))""")
def table_null_share(spark, d):
    return profile.table_null_share(D.hourly_wide(spark, d), TYPES)


PART_COLS = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")]


@query("column_profile", "G5", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CAST(min({c}) AS VARCHAR) AS min_value, "
    f"CAST(max({c}) AS VARCHAR) AS max_value, count(DISTINCT {c}) AS n_distinct, count({c}) AS n_non_null FROM part"
    for c, t in PART_COLS))
def column_profile(spark, d):
    return profile.column_profile(D.table(spark, d, "part"), [c for c, _ in PART_COLS])


@query("describe_stats", "G6", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, {R(f'avg({c})')} AS mean, {R(f'stddev_samp({c})')} AS std, "
    f"{R(f'min({c})')} AS min, {R(f'median({c})')} AS median, {R(f'max({c})')} AS max FROM ({S.HOURLY})"
    for c in TYPES))
def describe_stats(spark, d):
    return profile.describe(D.hourly_wide(spark, d), TYPES)


@query("duplicate_counts", "G7", """
SELECT n_rows, n_rows - n_distinct_rows AS n_duplicate_rows, n_rows - n_distinct_keys AS n_duplicate_keys
FROM (SELECT (SELECT count(*) FROM lineitem) AS n_rows,
             (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS n_distinct_rows,
             (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_distinct_keys)""")
def duplicate_counts(spark, d):
    return profile.duplicate_counts(D.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


PROBS = [0.01, 0.25, 0.5, 0.75, 0.99]


@query("quantiles", "G8", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS prob, {R(f'quantile_cont({c}, {p})')} AS value FROM ({S.HOURLY})"
    for c in TYPES for p in PROBS))
def quantiles(spark, d):
    return profile.quantiles(D.hourly_wide(spark, d), TYPES, PROBS)


@query("iqr_outliers", "G9", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", {R('q1')} AS q1, {R('q3')} AS q3, {R('q3 - q1')} AS iqr,
       {R('q1 - 1.5 * (q3 - q1)')} AS lower_fence, {R('q3 + 1.5 * (q3 - q1)')} AS upper_fence,
       n_out AS n_outliers, {R('n_out * 100.0 / n')} AS outlier_pct, coalesce(n_out * 100.0 / n > 5, false) AS flag
FROM (SELECT q1, q3, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_out,
             count({c}) AS n
      FROM ({S.HOURLY}) h, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM ({S.HOURLY}))
      GROUP BY q1, q3)""" for c in TYPES))
def iqr_outliers(spark, d):
    return profile.iqr_outliers(D.hourly_wide(spark, d), TYPES)


@query("iqr_by_series", "G9", f"""
WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
o AS (SELECT user_id, q1, q3, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_out,
             count(value) AS n FROM events JOIN q USING (user_id) GROUP BY 1, 2, 3)
SELECT user_id, 'value' AS "column", {R('q1')} AS q1, {R('q3')} AS q3, {R('q3 - q1')} AS iqr,
       {R('q1 - 1.5 * (q3 - q1)')} AS lower_fence, {R('q3 + 1.5 * (q3 - q1)')} AS upper_fence,
       n_out AS n_outliers, {R('n_out * 100.0 / n')} AS outlier_pct, coalesce(n_out * 100.0 / n > 5, false) AS flag FROM o""")
def iqr_by_series(spark, d):
    return profile.iqr_outliers(D.events(spark, d), ["value"], method="rank", series=["user_id"])


@query("raw_quantiles", "G8", f"""
SELECT event_type, prob, {R('value')} AS value, n FROM (
  SELECT event_type, quantile_cont(value, [0.01, 0.25, 0.5, 0.75, 0.99]) AS vs, count(value) AS n FROM events GROUP BY 1) g,
  LATERAL (SELECT unnest(vs) AS value, unnest([0.01, 0.25, 0.5, 0.75, 0.99]::DOUBLE[]) AS prob)""")
def raw_quantiles(spark, d):
    from ..operators.quantile import rank_quantiles
    return rank_quantiles(D.events(spark, d), "value", [0.01, 0.25, 0.5, 0.75, 0.99], ["event_type"])


@query("circular_mean_daily", "G25 D15", f"""
SELECT day, n, {R('CASE WHEN c * c + s * s > 1e-18 THEN degrees(atan2(s, c)) + CASE WHEN atan2(s, c) < 0 THEN 360 ELSE 0 END END')} AS direction
FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n, avg(sin(radians((value * 10) % 360))) AS s,
             avg(cos(radians((value * 10) % 360))) AS c FROM events GROUP BY 1)""")
def circular_mean_daily(spark, d):
    e = D.events(spark, d).select(floor_to("ts", "day").alias("day"), F.pmod(F.col("value") * 10, F.lit(360.0)).alias("_deg"))
    return e.groupBy("day").agg(F.count(F.lit(1)).alias("n"), circular_mean("_deg").alias("direction"))


# Unit lookup rules, first substring match wins (P10).
UNIT_RULES = [("click", "clicks/h"), ("view", "views/h"), ("error", "errors/h"), ("purchase", "EUR"),
              ("signup", "users/h")]


def unit_for(column: str) -> str:
    return unit_of(column, dict(UNIT_RULES))


@query("headline_stats", "G26 P10 T10", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, min(ts) FILTER (WHERE {c} IS NOT NULL) AS first_ts, "
    f"max(ts) FILTER (WHERE {c} IS NOT NULL) AS last_ts, {R(f'avg({c})')} AS mean, '{unit_for(c)}' AS unit, "
    f"strftime(min(ts) FILTER (WHERE {c} IS NOT NULL), '%d.%m.%Y') AS first_day "
    f"FROM ({S.HOURLY})" for c in TYPES))
def headline_stats(spark, d):
    h = profile.headline_stats(D.hourly_wide(spark, d), TYPES, "ts", {c: unit_for(c) for c in TYPES})
    return h.withColumn("first_day", date_label("first_ts"))


# The library's health limits by pollutant, mapped onto the stand-in columns.
LIMITS = dict(zip(["error", "click", "view", "purchase"], (HEALTH_LIMITS[k] for k in ("NO2", "PM10", "O3", "PM2"))))


@query("limit_exceedance", "P11", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({v} AS DOUBLE) AS limit_value, count(*) FILTER (WHERE {c} > {v}) AS n_exceed, "
    f"{R(f'count(*) FILTER (WHERE {c} > {v}) * 100.0 / count({c})')} AS exceed_pct FROM ({S.HOURLY})"
    for c, v in LIMITS.items()))
def limit_exceedance(spark, d):
    return profile.limit_exceedance(D.hourly_wide(spark, d), LIMITS)


@query("preview", "A10 P12 S2", f"SELECT ts, {_each(R('{c}') + ' AS {c}')} FROM ({S.HOURLY}) ORDER BY ts LIMIT 5")
def preview(spark, d):
    return profile.preview(D.hourly_wide(spark, d), ["ts"], 5)


# ---------------------------------------------------------------- timeline

_HOURS = """p AS (SELECT DISTINCT event_type AS parameter, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts FROM events),
b AS (SELECT parameter, min(ts) AS lo, max(ts) AS hi FROM p GROUP BY 1)"""


@query("missing_hours", "T8 T9 J3", f"""
WITH {_HOURS},
s AS (SELECT parameter, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM b)
SELECT s.parameter, s.ts FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.parameter = s.parameter AND p.ts = s.ts)""")
def missing_hours(spark, d):
    return timeline.missing_periods(D.events_long(spark, d), ["parameter"], "ts", "hour")


@query("time_completeness", "Q1", f"""
SELECT parameter, ts_min, ts_max, n_rows, n_present, n_expected, n_expected - n_present AS n_missing,
       {R('n_present * 100.0 / n_expected')} AS completeness_pct,
       {R('n_rows * 100.0 / n_expected')} AS row_completeness_pct,
       n_present * 100.0 / n_expected >= 95 AS ok
FROM (SELECT event_type AS parameter, min(date_trunc('hour', ts)) AS ts_min, max(date_trunc('hour', ts)) AS ts_max,
             count(*) AS n_rows, count(DISTINCT date_trunc('hour', ts)) AS n_present,
             date_diff('hour', min(date_trunc('hour', ts)), max(date_trunc('hour', ts))) + 1 AS n_expected
      FROM events GROUP BY 1)""")
def time_completeness(spark, d):
    return timeline.completeness(D.events_long(spark, d), ["parameter"], "ts", "hour")


@query("row_completeness", "Q2", f"""
SELECT event_type AS parameter, count(*) AS n_rows,
       date_diff('hour', min(date_trunc('hour', ts)), max(date_trunc('hour', ts))) + 1 AS n_expected,
       {R("count(*) * 100.0 / (date_diff('hour', min(date_trunc('hour', ts)), max(date_trunc('hour', ts))) + 1)")}
         AS row_completeness_pct
FROM events GROUP BY 1""")
def row_completeness(spark, d):
    c = timeline.completeness(D.events_long(spark, d), ["parameter"], "ts", "hour")
    return c.select("parameter", "n_rows", "n_expected", "row_completeness_pct")


@query("localize", "T5 T3", """
SELECT event_id, ts, CAST(timezone('UTC', timezone('Europe/Zurich', ts)) AS TIMESTAMP) AS ts_utc FROM events""")
def localize_q(spark, d):
    e = D.events(spark, d)
    return e.select("event_id", "ts", localize("ts", D.ZONE).alias("ts_utc"))


@query("month_labels", "T10", """
SELECT CAST(month(o_orderdate) AS INTEGER) AS month, strftime(o_orderdate, '%b') AS month_label, count(*) AS n
FROM orders GROUP BY 1, 2""")
def month_labels(spark, d):
    o = D.table(spark, d, "orders")
    return o.groupBy(F.month("o_orderdate").cast("int").alias("month"),
                     month_label("o_orderdate").alias("month_label")).agg(F.count(F.lit(1)).alias("n"))


def _daily_sql(select: str) -> str:
    return f"""
WITH h AS ({S.HOURLY}),
dd AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, {select} FROM h GROUP BY 1),
b AS (SELECT min(date_trunc('day', ts)) AS lo, max(date_trunc('day', ts)) AS hi FROM h),
s AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS TIMESTAMP) AS ts FROM b)"""


@query("daily_median", "G10", _daily_sql(_each("median({c}) AS {c}"))
       + f" SELECT s.ts, {_each(R('dd.{c}') + ' AS {c}')} FROM s LEFT JOIN dd USING (ts)")
def daily_median(spark, d):
    return timeline.resample(D.hourly_wide(spark, d), {c: F.median(c) for c in TYPES}, unit="day")


@query("daily_mean", "G11", _daily_sql(_each("avg({c}) AS {c}"))
       + f" SELECT s.ts, {_each(R('dd.{c}') + ' AS {c}')} FROM s LEFT JOIN dd USING (ts)")
def daily_mean(spark, d):
    return timeline.resample(D.hourly_wide(spark, d), {c: F.avg(c) for c in TYPES}, unit="day")


@query("daily_multi_agg", "G12", _daily_sql(
    "median(click) AS click, avg(error) AS error, sum(purchase) AS purchase, avg(signup) AS signup, avg(view) AS view")
    + f""" SELECT s.ts, {R('dd.click')} AS click, {R('dd.error')} AS error, {R('coalesce(dd.purchase, 0)')} AS purchase,
       {R('dd.signup')} AS signup, {R('dd.view')} AS view FROM s LEFT JOIN dd USING (ts)""")
def daily_multi_agg(spark, d):
    aggs = {"click": F.median("click"), "error": F.avg("error"), "purchase": F.sum("purchase"),
            "signup": F.avg("signup"), "view": F.avg("view")}
    return timeline.resample(D.hourly_wide(spark, d), aggs, unit="day", zero_fill=["purchase"])


@query("rolling7_centered", "W4", f"""
WITH o AS ({S.ORDERS_DAILY}),
b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM o),
s AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS TIMESTAMP) AS ts FROM b),
x AS (SELECT s.ts, o.p1_urgent FROM s LEFT JOIN o USING (ts))
SELECT ts, {R('p1_urgent')} AS p1_urgent,
       {R('CASE WHEN count(p1_urgent) OVER w >= 4 THEN avg(p1_urgent) OVER w END')} AS rolling
FROM x WINDOW w AS (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def rolling7_centered(spark, d):
    daily = timeline.resample(D.orders_daily(spark, d), {"p1_urgent": F.avg("p1_urgent")}, unit="day")
    return timeline.rolling_centered(daily, "p1_urgent", unit="day", window=7, min_periods=4)


@query("forward_fill", "W6", f"""
SELECT ts, {_each(R('last_value({c} IGNORE NULLS) OVER w') + ' AS {c}')}
FROM ({S.HOURLY}) WINDOW w AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def forward_fill(spark, d):
    return scan.forward_fill(D.hourly_wide(spark, d), [], "ts", TYPES)


@query("lag_values", "W5", f"""
SELECT ts, {R('click')} AS click, {R('lag(click, 1) OVER w')} AS click_lag1, {R('lag(click, 3) OVER w')} AS click_lag3
FROM ({S.HOURLY}) WINDOW w AS (ORDER BY ts)""")
def lag_values(spark, d):
    h = D.hourly_wide(spark, d).select("ts", "click")
    return scan.lags(h, [], "ts", {"click_lag1": ("click", 1), "click_lag3": ("click", 3)})


@query("localize_filled", "T5 T6 W6", """
SELECT event_id, ts, CAST(last_value(CAST(timezone('UTC', timezone('Europe/Zurich', ts)) AS TIMESTAMP) IGNORE NULLS)
       OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS TIMESTAMP) AS ts_utc FROM events""")
def localize_filled(spark, d):
    e = D.events(spark, d).select("event_id", "ts")
    return timeline.localize_filled(e, "ts", D.ZONE, bucket="day")


# Wall clocks of seven years, six hours around every night: both transitions of every year are crossed.
_DST_STAMPS = ("SELECT l_orderkey, l_linenumber, l_shipdate + to_hours(CAST(l_orderkey % 6 AS INTEGER)) "
               "+ to_minutes(CAST((l_partkey * 7) % 60 AS INTEGER)) AS ts FROM lineitem")
_BACK = "timezone('Europe/Zurich', timezone('UTC', {0}))"


@query("localize_dst", "T5 D6", f"""
WITH s AS ({_DST_STAMPS}),
u AS (SELECT *, CAST(timezone('UTC', timezone('Europe/Zurich', ts)) AS TIMESTAMP) AS guess FROM s),
k AS (SELECT *, CASE WHEN CAST({_BACK.format('guess')} AS TIMESTAMP) <> ts THEN 'gap'
                     WHEN CAST({_BACK.format('guess + INTERVAL 1 HOUR')} AS TIMESTAMP) = ts
                       OR CAST({_BACK.format('guess - INTERVAL 1 HOUR')} AS TIMESTAMP) = ts THEN 'fold' ELSE 'plain' END AS kind FROM u)
SELECT l_orderkey, l_linenumber, ts, kind,
       CASE kind WHEN 'fold' THEN NULL WHEN 'gap' THEN date_trunc('hour', guess) ELSE guess END AS ts_utc FROM k""")
def localize_dst(spark, d):
    return zones.localized(_dst_stamps(spark, d), "ts", D.ZONE, kind="kind")


@query("localize_dst_filled", "T6 D6", f"""
WITH s AS ({_DST_STAMPS}),
u AS (SELECT *, CAST(timezone('UTC', timezone('Europe/Zurich', ts)) AS TIMESTAMP) AS guess FROM s),
k AS (SELECT *, CASE WHEN CAST({_BACK.format('guess')} AS TIMESTAMP) <> ts THEN date_trunc('hour', guess)
                     WHEN CAST({_BACK.format('guess + INTERVAL 1 HOUR')} AS TIMESTAMP) = ts
                       OR CAST({_BACK.format('guess - INTERVAL 1 HOUR')} AS TIMESTAMP) = ts THEN NULL ELSE guess END AS own FROM u)
SELECT l_orderkey, l_linenumber, ts, last_value(own IGNORE NULLS) OVER (
         PARTITION BY l_linenumber ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ts_utc FROM k""")
def localize_dst_filled(spark, d):
    return timeline.localize_filled(_dst_stamps(spark, d), "ts", D.ZONE, ["l_linenumber"])


def _dst_stamps(spark, d):
    return D.table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "timestampadd(MINUTE, l_partkey * 7 % 60, "
        "timestampadd(HOUR, l_orderkey % 6, CAST(l_shipdate AS TIMESTAMP_NTZ))) AS ts")


@query("time_completeness_by_series", "Q1 T8", f"""
SELECT user_id, ts_min, ts_max, n_rows, n_present, n_expected, n_expected - n_present AS n_missing,
       {R('n_present * 100.0 / n_expected')} AS completeness_pct,
       {R('n_rows * 100.0 / n_expected')} AS row_completeness_pct,
       n_present * 100.0 / n_expected >= 95 AS ok
FROM (SELECT user_id, min(date_trunc('hour', ts)) AS ts_min, max(date_trunc('hour', ts)) AS ts_max,
             count(*) AS n_rows, count(DISTINCT date_trunc('hour', ts)) AS n_present,
             date_diff('hour', min(date_trunc('hour', ts)), max(date_trunc('hour', ts))) + 1 AS n_expected
      FROM events GROUP BY 1)""")
def time_completeness_by_series(spark, d):
    e = D.events(spark, d).select("user_id", "ts")
    return timeline.completeness(e, ["user_id"], "ts", "hour")
