"""Registered queries: cleaning and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, features, profile, scan
from . import sqlbase as S
from . import standins as D
from .registry import query
from .sqlbase import R

TYPES = D.EVENT_TYPES
PCOLS = D.PRIORITY_COLS


def _each(fmt: str, cols, sep: str = ", ") -> str:
    return sep.join(fmt.format(c=c) for c in cols)


def interp_sql(src: str, cols, limit: int = 3, mode: str = "limit", series: str | None = None) -> str:
    """SQL twin of ``scan.interpolate`` ordered by ts (optionally per series)."""
    part = f"PARTITION BY {series} " if series else ""
    w_prev = f"OVER ({part}ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    w_next = f"OVER ({part}ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    nb = ", ".join(
        f"last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {w_prev} AS pp_{c}, "
        f"last_value({c} IGNORE NULLS) {w_prev} AS pv_{c}, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {w_next} AS np_{c}, "
        f"first_value({c} IGNORE NULLS) {w_next} AS nv_{c}" for c in cols)
    outs = []
    for c in cols:
        lin = f"pv_{c} + (nv_{c} - pv_{c}) * (pos - pp_{c}) / (np_{c} - pp_{c})"
        if mode == "limit":
            fill = (f"CASE WHEN pp_{c} IS NULL THEN NULL WHEN pos - pp_{c} > {limit} THEN NULL "
                    f"WHEN np_{c} IS NULL THEN pv_{c} ELSE {lin} END")
        else:
            fill = (f"CASE WHEN pp_{c} IS NULL OR np_{c} IS NULL THEN NULL "
                    f"WHEN np_{c} - pp_{c} - 1 > {limit} THEN NULL ELSE {lin} END")
        outs.append(f"coalesce({c}, {fill}) AS {c}")
    key = f"{series}, " if series else ""
    return (f"SELECT {key}ts, {', '.join(outs)} FROM (SELECT *, {nb} FROM "
            f"(SELECT *, row_number() OVER ({part}ORDER BY ts) AS pos FROM ({src})))")


def runs_sql(src: str, cols, series: str | None = None) -> str:
    """Longest null run per column (gaps and islands) by ts, optionally per series."""
    parts = []
    part = f"PARTITION BY {series} " if series else ""
    part2 = f"PARTITION BY {series}, " if series else "PARTITION BY "
    for c in cols:
        if series:
            parts.append(
                f"SELECT s.{series}, '{c}' AS \"column\", CAST(coalesce(max(cnt), 0) AS BIGINT) AS max_run "
                f"FROM (SELECT DISTINCT {series} FROM ({src})) s LEFT JOIN ("
                f"SELECT {series}, grp, count(*) AS cnt FROM (SELECT {series}, {c} IS NULL AS z, "
                f"row_number() OVER ({part}ORDER BY ts) - row_number() OVER ({part2}{c} IS NULL ORDER BY ts) AS grp "
                f"FROM ({src})) WHERE z GROUP BY {series}, grp) g ON s.{series} = g.{series} GROUP BY s.{series}")
        else:
            parts.append(
                f"SELECT '{c}' AS \"column\", CAST(coalesce(max(cnt), 0) AS BIGINT) AS max_run FROM ("
                f"SELECT grp, count(*) AS cnt FROM (SELECT {c} IS NULL AS z, row_number() OVER (ORDER BY ts) - "
                f"row_number() OVER ({part2}{c} IS NULL ORDER BY ts) AS grp FROM ({src})) WHERE z GROUP BY grp)")
    return " UNION ALL ".join(parts)


# ---------------------------------------------------------------- cleaning

LI_KEYS = ["l_orderkey", "l_linenumber"]
LI_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
           "l_returnflag", "l_linestatus", "l_shipdate"]
LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LI_DOUBLE = {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}


@query("dedupe_first", "W1", f"""
SELECT {', '.join(R(c) + ' AS ' + c if c in LI_DOUBLE else c for c in LI_ALL)}
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY {', '.join(c + ' NULLS FIRST' for c in LI_REST)}) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_first(spark, d):
    return cleaning.dedupe_first(D.table(spark, d, "lineitem"), LI_KEYS)


ACCT_RULE = {"ACCTBAL": (0, 5000)}


@query("bounds_to_null", "K1 P3", f"""
SELECT c_custkey, {R('CASE WHEN c_acctbal < 0 OR c_acctbal > 5000 THEN NULL ELSE c_acctbal END')} AS c_acctbal
FROM customer""")
def bounds_to_null(spark, d):
    c = D.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return cleaning.bounds_to_null(c, ACCT_RULE, substring=True)


@query("negative_to_null", "K2", f"""
SELECT c_custkey, {R('CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END')} AS c_acctbal FROM customer""")
def negative_to_null(spark, d):
    c = D.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return cleaning.negative_to_null(c, ["c_acctbal"])


@query("rule_violations", "G28 G29", """
SELECT 'c_acctbal' AS "column", CAST(0 AS DOUBLE) AS min_rule, CAST(5000 AS DOUBLE) AS max_rule,
       count(*) FILTER (WHERE c_acctbal < 0 OR c_acctbal > 5000) AS n_violations FROM customer""")
def rule_violations(spark, d):
    return cleaning.bounds_violations(D.table(spark, d, "customer"), ACCT_RULE, substring=True)


@query("missing_flags", "K3 P13", f"""
SELECT ts, {_each(R('{c}') + ' AS {c}', TYPES)}, {_each('CAST({c} IS NULL AS INTEGER) AS {c}_missing', TYPES)}
FROM ({S.HOURLY})""")
def missing_flags(spark, d):
    return cleaning.missing_flags(D.hourly_wide(spark, d), TYPES)


@query("monthly_missing_rate", "G13", " UNION ALL ".join(
    f"SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, count(*) AS n_rows, "
    f"'{c}' AS \"column\", {R(f'avg(CAST({c} IS NULL AS INTEGER)) * 100')} AS missing_pct "
    f"FROM ({S.ORDERS_DAILY}) GROUP BY 1, 2" for c in PCOLS))
def monthly_missing_rate(spark, d):
    return cleaning.monthly_missing_rate(D.orders_daily(spark, d), PCOLS)


@query("missing_run_max", "W3", runs_sql(S.ORDERS_DAILY, PCOLS))
def missing_run_max(spark, d):
    return scan.null_runs(D.orders_daily(spark, d), [], "ts", PCOLS, bucket="year")


def _class_sql() -> str:
    parts = []
    for c in PCOLS:
        parts.append(f"""
SELECT '{c}' AS "column", n_missing, {R('n_missing * 100.0 / n_rows')} AS missing_pct, {R('cv')} AS cv, max_run,
  CASE WHEN cv < 0.4 AND max_run <= 6 THEN 'MCAR' WHEN cv >= 0.6 THEN 'MAR'
       WHEN max_run > 24 THEN 'MCAR (outage)' ELSE 'MAR/MCAR' END AS missing_class
FROM (SELECT count(*) AS n_rows, count(*) - count({c}) AS n_missing FROM ({S.ORDERS_DAILY})) a,
     (SELECT CASE WHEN avg(r) > 0 THEN stddev_samp(r) / avg(r) ELSE 0.0 END AS cv
      FROM (SELECT avg(CAST({c} IS NULL AS INTEGER)) * 100 AS r FROM ({S.ORDERS_DAILY})
            GROUP BY year(ts), month(ts))) b,
     (SELECT max_run FROM ({runs_sql(S.ORDERS_DAILY, [c])})) c
WHERE n_missing > 0""")
    return " UNION ALL ".join(parts)


@query("missingness_class", "G14 K4", _class_sql())
def missingness_class(spark, d):
    return cleaning.missingness_class(D.orders_daily(spark, d), PCOLS, bucket="year")


def _matrix_sql() -> str:
    parts = []
    for c in PCOLS:
        parts.append(f"""
SELECT '{c}' AS "column", {R('cv')} AS cv, n_active, active_months,
  CASE WHEN cv >= 0.5 AND n_active * 2 <= slots THEN 'MAR' WHEN cv < 0.35 THEN 'MCAR' ELSE 'MCAR/MAR' END AS missing_class
FROM (SELECT CASE WHEN s > 0 THEN sqrt(greatest(sq / slots - (s / slots) * (s / slots), 0.0)) / (s / slots)
                  ELSE 0.0 END AS cv, slots,
             CAST(count(*) FILTER (WHERE rate > 0.05) AS INTEGER) AS n_active, mx,
             coalesce(string_agg(printf('%04d-%02d', year, month), ',' ORDER BY year, month) FILTER (WHERE rate > 0.05), '')
               AS active_months
      FROM (SELECT year, month, rate, sum(rate) OVER () AS s, sum(rate * rate) OVER () AS sq, max(rate) OVER () AS mx,
                   (max(year) OVER () - min(year) OVER () + 1) * 12 AS slots
            FROM (SELECT year(ts) AS year, month(ts) AS month, avg(CAST({c} IS NULL AS INTEGER)) AS rate
                  FROM ({S.ORDERS_DAILY}) GROUP BY 1, 2))
      GROUP BY s, sq, mx, slots)
WHERE mx > 0""")
    return " UNION ALL ".join(parts)


@query("missingness_class_matrix", "G15 K5", _matrix_sql())
def missingness_class_matrix(spark, d):
    return cleaning.missingness_class_matrix(D.orders_daily(spark, d), PCOLS)


@query("interpolate_limit", "W2", f"SELECT ts, {_each(R('{c}') + ' AS {c}', TYPES)} FROM ({interp_sql(S.HOURLY, TYPES)})")
def interpolate_limit(spark, d):
    return scan.interpolate(D.hourly_wide(spark, d), [], "ts", TYPES, limit=3, mode="limit", bucket="day")


@query("interpolate_short_gaps", "W2 D1",
       f"SELECT ts, {_each(R('{c}') + ' AS {c}', TYPES)} FROM ({interp_sql(S.HOURLY, TYPES, mode='short_gaps')})")
def interpolate_short_gaps(spark, d):
    return scan.interpolate(D.hourly_wide(spark, d), [], "ts", TYPES, limit=3, mode="short_gaps", bucket="day")


@query("interpolate_by_series", "W2",
       f"SELECT user_id, ts, {_each(R('{c}') + ' AS {c}', TYPES)} FROM ({interp_sql(S.USER_HOURLY, TYPES, series='user_id')})")
def interpolate_by_series(spark, d):
    return scan.interpolate(D.user_hourly(spark, d), ["user_id"], "ts", TYPES, limit=3, bucket="day")


@query("missing_run_by_series", "W3", runs_sql(S.USER_HOURLY, TYPES, series="user_id"))
def missing_run_by_series(spark, d):
    return scan.null_runs(D.user_hourly(spark, d), ["user_id"], "ts", TYPES, bucket="day")


@query("forward_fill_by_series", "W6", f"""
SELECT user_id, ts, {_each(R('last_value({c} IGNORE NULLS) OVER w') + ' AS {c}', TYPES)}
FROM ({S.USER_HOURLY}) WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def forward_fill_by_series(spark, d):
    return scan.forward_fill(D.user_hourly(spark, d), ["user_id"], "ts", TYPES, bucket="day")


@query("interpolate_daily", "W2", f"SELECT ts, {_each(R('{c}') + ' AS {c}', PCOLS)} FROM ({interp_sql(S.ORDERS_DAILY, PCOLS)})")
def interpolate_daily(spark, d):
    return scan.interpolate(D.orders_daily(spark, d), [], "ts", PCOLS, limit=3, bucket="year")


@query("remaining_nulls", "K7", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, "
    f"{R(f'(count(*) - count({c})) * 100.0 / count(*)')} AS null_pct "
    f"FROM ({interp_sql(S.ORDERS_DAILY, PCOLS)})) WHERE n_null > 0" for c in PCOLS))
def remaining_nulls(spark, d):
    filled = scan.interpolate(D.orders_daily(spark, d), [], "ts", PCOLS, limit=3, bucket="year")
    return profile.null_profile(filled, PCOLS)


def _winsor_sql(threshold: float) -> str:
    q = ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in TYPES)
    dd = ", ".join(f"count(*) FILTER (WHERE {c} < lo_{c} OR {c} > hi_{c}) * 100.0 / count({c}) > {threshold} AS do_{c}"
                   for c in TYPES)
    outs = ", ".join(
        R(f"CASE WHEN coalesce(do_{c}, false) THEN (CASE WHEN {c} < lo_{c} THEN lo_{c} WHEN {c} > hi_{c} THEN hi_{c} "
          f"ELSE {c} END) ELSE {c} END") + f" AS {c}" for c in TYPES)
    return (f"WITH h AS ({S.HOURLY}), q AS (SELECT {q} FROM h), dd AS (SELECT {dd} FROM h, q) "
            f"SELECT ts, {outs} FROM h, q, dd")


@query("winsorize", "K6", _winsor_sql(3.0))
def winsorize(spark, d):
    return cleaning.winsorize(D.hourly_wide(spark, d), TYPES, threshold_pct=3.0)


@query("winsorize_forced", "K6 D2", _winsor_sql(0.0))
def winsorize_forced(spark, d):
    return cleaning.winsorize(D.hourly_wide(spark, d), TYPES, threshold_pct=0.0)


@query("winsorize_report", "K6", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", {R('lo')} AS q_low, {R('hi')} AS q_high, n_out AS n_outside,
       {R('n_out * 100.0 / n')} AS outside_pct, coalesce(n_out * 100.0 / n > 3.0, false) AS winsorized
FROM (SELECT lo, hi, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS n_out, count({c}) AS n
      FROM ({S.HOURLY}) h, (SELECT quantile_cont({c}, 0.01) AS lo, quantile_cont({c}, 0.99) AS hi FROM ({S.HOURLY}))
      GROUP BY lo, hi)""" for c in TYPES))
def winsorize_report(spark, d):
    return cleaning.winsorize_report(D.hourly_wide(spark, d), TYPES)


@query("winsorize_by_series", "K6", f"""
WITH q AS (SELECT user_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1),
dd AS (SELECT user_id, lo, hi, count(*) FILTER (WHERE value < lo OR value > hi) * 100.0 / count(value) > 3.0 AS clip
       FROM events JOIN q USING (user_id) GROUP BY 1, 2, 3)
SELECT event_id, user_id, {R('CASE WHEN clip THEN least(greatest(value, lo), hi) ELSE value END')} AS value FROM events JOIN dd USING (user_id)""")
def winsorize_by_series(spark, d):
    e = D.events(spark, d).select("event_id", "user_id", "value")
    return cleaning.winsorize(e, ["value"], method="rank", series=["user_id"])


@query("scale_by_series", "F10 F11", f"""
WITH f AS (SELECT user_id, avg(value) AS mu, stddev_pop(value) AS sd, min(value) AS mn, max(value) AS mx FROM events GROUP BY 1)
SELECT event_id, user_id, {R('(value - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END')} AS value_std,
       {R('(value - mn) / CASE WHEN mx = mn THEN 1 ELSE mx - mn END')} AS value_norm FROM events JOIN f USING (user_id)""")
def scale_by_series(spark, d):
    e = D.events(spark, d).select("event_id", "user_id", "value")
    return features.scale(e, ["value"], series=["user_id"]).drop("value")


def _arc(limit: int) -> str:
    way = "((nv - pv + 540.0) % 360.0 - 180.0)"  # both in [0, 360), so the dividend is positive
    lin = f"(pv + {way} * (pos - pp) / (np - pp) + 360.0) % 360.0"
    return (f"coalesce(x, CASE WHEN pp IS NULL OR pos - pp > {limit} THEN NULL WHEN np IS NULL THEN pv ELSE {lin} END)")


@query("interpolate_circular", "W2 D15", f"""
WITH h AS (SELECT user_id, ts, (signup * 10) % 360 AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS pos FROM ({S.USER_HOURLY})),
n AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS pp, last_value(x IGNORE NULLS) OVER p AS pv,
             first_value(CASE WHEN x IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS np, first_value(x IGNORE NULLS) OVER f AS nv
      FROM h WINDOW p AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    f AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, ts, {R(_arc(3))} AS direction FROM n""")
def interpolate_circular(spark, d):
    h = D.user_hourly(spark, d).select("user_id", "ts", F.pmod(F.col("signup") * 10, F.lit(360.0)).alias("direction"))
    return scan.interpolate(h, ["user_id"], "ts", ["direction"], limit=3, bucket="day", circular=["direction"])


ORDER_BOUNDS = {c: (1000.0, 400000.0) for c in PCOLS}


def _bounded_sql() -> str:
    return (f"SELECT ts, {_each('CASE WHEN {c} < 1000.0 OR {c} > 400000.0 THEN NULL ELSE {c} END AS {c}', PCOLS)} "
            f"FROM ({S.ORDERS_DAILY})")


def _nulls_sql(stage: str, src: str) -> str:
    return (f"SELECT '{stage}' AS stage, count(*) AS n_rows, "
            f"CAST({_each('(count(*) - count({c}))', PCOLS, ' + ')} AS BIGINT) AS n_null_cells FROM ({src})")


@query("clean_before_after", "G29 K8", " UNION ALL ".join([
    _nulls_sql("raw", S.ORDERS_DAILY), _nulls_sql("bounds", _bounded_sql()),
    _nulls_sql("interpolated", interp_sql(_bounded_sql(), PCOLS))]))
def clean_before_after(spark, d):
    raw = D.orders_daily(spark, d)
    bounded = cleaning.bounds_to_null(raw, ORDER_BOUNDS)
    filled = scan.interpolate(bounded, [], "ts", PCOLS, limit=3, bucket="year")
    return (cleaning.null_totals(raw, PCOLS, "raw")
            .unionByName(cleaning.null_totals(bounded, PCOLS, "bounds"))
            .unionByName(cleaning.null_totals(filled, PCOLS, "interpolated")))


# ---------------------------------------------------------------- features

@query("calendar_features", "F1 F2 F3 F4 J6", f"""
SELECT o_orderkey, o_orderdate AS ts, CAST(hour(o_orderdate) AS INTEGER) AS hour,
       CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, CAST(month(o_orderdate) AS INTEGER) AS month,
       {S.season_sql('month(o_orderdate)')} AS season, CAST(isodow(o_orderdate) - 1 >= 5 AS INTEGER) AS is_weekend,
       CAST(hour(o_orderdate) IN (7, 8, 9, 17, 18, 19) AS INTEGER) AS is_rush_hour FROM orders""")
def calendar_features(spark, d):
    o = D.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    return features.calendar_features(o, "ts")


@query("category_bins", "F5 F7", f"""
SELECT ts, {R('signup')} AS signup, {R('purchase')} AS purchase,
       {S.bins_sql('signup', [-30, 0, 10, 20, 30, 50], ['Frost', 'Kalt', 'Mild', 'Warm', 'Heiss'])} AS temp_category,
       {S.bins_sql('purchase', [0, 5, 20, 40, 300], ['Windstill', 'Leicht', 'Mässig', 'Stark'])} AS wind_category
FROM ({S.HOURLY})""")
def category_bins(spark, d):
    h = D.hourly_wide(spark, d).select("ts", "signup", "purchase")
    return features.category_features(h, temperature="signup", wind_speed="purchase")


@query("condition_flag", "F6", f"""
SELECT ts, {R('purchase')} AS purchase, CAST(coalesce(purchase > 0.1, false) AS INTEGER) AS rain FROM ({S.HOURLY})""")
def condition_flag(spark, d):
    return features.rain_flag(D.hourly_wide(spark, d).select("ts", "purchase"), "purchase")


@query("joint_extreme_flag", "F8", f"""
WITH h AS ({S.HOURLY}), q AS (SELECT quantile_cont(purchase, 0.75) AS qh, quantile_cont(signup, 0.25) AS ql FROM h)
SELECT ts, {R('purchase')} AS purchase, {R('signup')} AS signup,
       CAST(coalesce(purchase > qh AND signup < ql, false) AS INTEGER) AS inversion FROM h, q""")
def joint_extreme_flag(spark, d):
    h = D.hourly_wide(spark, d).select("ts", "purchase", "signup")
    return features.joint_extreme_flag(h, "purchase", "signup")


@query("unit_scale", "F9", f"SELECT ts, {R('purchase')} AS purchase, {R('purchase / 3600.0')} AS sunshine_h FROM ({S.HOURLY})")
def unit_scale(spark, d):
    return features.unit_scale(D.hourly_wide(spark, d).select("ts", "purchase"), "purchase", 3600.0, "sunshine_h")


def _scale_sql(src: str, cols, kinds=("std", "norm"), keep=None) -> str:
    keep = keep or ["ts", *cols]
    stats = ", ".join(
        f"avg(coalesce({c}, 0)) AS mu_{c}, stddev_pop(coalesce({c}, 0)) AS sd_{c}, "
        f"min(coalesce({c}, 0)) AS mn_{c}, max(coalesce({c}, 0)) AS mx_{c}" for c in cols)
    outs = []
    for c in cols:
        if "std" in kinds:
            outs.append(R(f"(coalesce({c}, 0) - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1.0 ELSE sd_{c} END") + f" AS {c}_std")
        if "norm" in kinds:
            outs.append(R(f"(coalesce({c}, 0) - mn_{c}) / CASE WHEN mx_{c} - mn_{c} = 0 THEN 1.0 ELSE mx_{c} - mn_{c} END")
                        + f" AS {c}_norm")
    return f"WITH h AS ({src}), st AS (SELECT {stats} FROM h) SELECT {', '.join(keep)}, {', '.join(outs)} FROM h, st"


@query("zscore", "F10", _scale_sql(S.HOURLY, TYPES, ("std",), ["ts"]))
def zscore(spark, d):
    return features.scale(D.hourly_wide(spark, d), TYPES, ("std",)).drop(*TYPES)


@query("minmax", "F11", _scale_sql(S.HOURLY, TYPES, ("norm",), ["ts"]))
def minmax(spark, d):
    return features.scale(D.hourly_wide(spark, d), TYPES, ("norm",)).drop(*TYPES)


FINAL_NUM = ["click", "error", "view", "purchase", "signup", "sunshine_h"]
FINAL_KEEP = ["ts", *[R(c) + " AS " + c for c in FINAL_NUM], "hour", "weekday", "month", "season", "is_weekend",
              "is_rush_hour", "temp_category", "wind_category", "rain", "inversion"]


@query("final_table", "J4 F1-F11", _scale_sql(S.FINAL, FINAL_NUM, keep=FINAL_KEEP))
def final_table(spark, d):
    return features.scale(D.final_table(spark, d), FINAL_NUM)
