"""Registered queries: correlation, distributions, hypothesis tests, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timecols import season_ordinal
from ..operators import correlation, distribution, hypothesis, quality
from ..operators import features
from . import sqlbase as S
from . import standins as D
from .registry import query
from .sqlbase import R
from .sqlstats import avg_rank_sql, pearson_sql, pvalue_cte, t_from_r_sql

TYPES = D.EVENT_TYPES
PAIRS = [(a, b) for i, a in enumerate(TYPES) for b in TYPES[i + 1:]]


def _each(fmt: str, cols, sep: str = ", ") -> str:
    return sep.join(fmt.format(c=c) for c in cols)


# ---------------------------------------------------------------- correlation

@query("pearson_matrix", "C1", " UNION ALL ".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, {R(pearson_sql(a, b))} AS r, "
    f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM ({S.HOURLY})" for a, b in PAIRS))
def pearson_matrix(spark, d):
    return correlation.pearson_matrix(D.hourly_wide(spark, d), TYPES)


def _spearman_sql(src: str, a: str, b: str, where: str = "") -> str:
    cond = f"{a} IS NOT NULL AND {b} IS NOT NULL" + (f" AND {where}" if where else "")
    return (f"SELECT '{a}' AS var_a, '{b}' AS var_b, {R(pearson_sql('rx', 'ry'))} AS rho, count(*) AS n FROM ("
            f"SELECT {avg_rank_sql('x')} AS rx, {avg_rank_sql('y')} AS ry FROM ("
            f"SELECT round({a}, 6) AS x, round({b}, 6) AS y FROM ({src}) WHERE {cond}))")


@query("spearman_matrix", "C2 W7", " UNION ALL ".join(_spearman_sql(S.HOURLY, a, b) for a, b in PAIRS))
def spearman_matrix(spark, d):
    return correlation.spearman_matrix(D.hourly_wide(spark, d), TYPES, key=["ts"])


CROSS = [(a, b) for a, b in PAIRS if (a in D.AIR) != (b in D.AIR)]


@query("top_correlations", "C3 S1 S2", f"""
SELECT var_a, var_b, {R('r')} AS r, n, {R('abs(r)')} AS abs_r FROM (
  {" UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, {pearson_sql(a, b)} AS r, "
                      f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM ({S.HOURLY})"
                      for a, b in CROSS)})
WHERE r IS NOT NULL ORDER BY abs(r) DESC, var_a, var_b LIMIT 10""")
def top_correlations(spark, d):
    m = correlation.pearson_matrix(D.hourly_wide(spark, d), TYPES)
    return correlation.top_pairs(m, D.AIR, D.WEATHER, 10)


RELEVANCE = ["purchase", "signup", "error", "view"]


@query("target_relevance", "C4", f"""
SELECT feature, {R('r')} AS r, n, CAST(row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, feature) AS INTEGER) AS rank
FROM ({" UNION ALL ".join(f"SELECT '{f}' AS feature, {pearson_sql(f, 'click')} AS r, "
                          f"count(*) FILTER (WHERE {f} IS NOT NULL AND click IS NOT NULL) AS n FROM ({S.HOURLY})"
                          for f in RELEVANCE)})""")
def target_relevance(spark, d):
    return correlation.target_relevance(D.hourly_wide(spark, d), "click", RELEVANCE)


@query("conditional_correlation", "C5 P5", f"""
SELECT 'click' AS var_a, 'signup' AS var_b, {R(pearson_sql('click', 'signup'))} AS r,
       count(*) FILTER (WHERE click IS NOT NULL AND signup IS NOT NULL) AS n
FROM ({S.HOURLY}) WHERE purchase > 50""")
def conditional_correlation(spark, d):
    return correlation.conditional_correlation(D.hourly_wide(spark, d), "click", "signup", F.col("purchase") > 50)


_LAG_SQL = f"""
WITH h AS ({S.HOURLY}),
c AS (SELECT ts, purchase AS x, click AS y FROM h WHERE purchase IS NOT NULL AND click IS NOT NULL),
p AS (SELECT *, row_number() OVER (ORDER BY ts) AS pos FROM c),
k AS (SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS lag),
pr AS (SELECT k.lag, a.x, b.y FROM p a, k, p b WHERE b.pos = a.pos + k.lag),
pe AS (SELECT lag, {pearson_sql('x', 'y')} AS pearson, count(*) AS n FROM pr GROUP BY lag),
rk AS (SELECT lag, {avg_rank_sql('round(x, 6)', 'lag')} AS rx, {avg_rank_sql('round(y, 6)', 'lag')} AS ry FROM pr),
sp AS (SELECT lag, {pearson_sql('rx', 'ry')} AS spearman FROM rk GROUP BY lag)"""


@query("lag_correlation", "C6 W5 D13 P4", _LAG_SQL + f"""
SELECT lag, {R('pearson')} AS pearson, n, {R('spearman')} AS spearman FROM pe JOIN sp USING (lag)""")
def lag_correlation(spark, d):
    return correlation.lag_correlation(D.hourly_wide(spark, d), "purchase", "click", 6, bucket="day")


@query("strongest_lag", "S4", _LAG_SQL + f"""
SELECT arg_min(lag, pearson) AS lag, {R('min(pearson)')} AS pearson FROM pe""")
def strongest_lag(spark, d):
    return correlation.strongest_lag(
        correlation.lag_correlation(D.hourly_wide(spark, d), "purchase", "click", 6, bucket="day", spearman=False))


def _quad_sql(src: str, x: str, y: str) -> str:
    def det3(a, b, c, d_, e, f, g, h, i):
        return f"(({a}) * (({e}) * ({i}) - ({f}) * ({h})) - ({b}) * (({d_}) * ({i}) - ({f}) * ({g})) + ({c}) * (({d_}) * ({h}) - ({e}) * ({g})))"
    det = det3("n", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4")
    a0 = f"({det3('t0', 's1', 's2', 't1', 's2', 's3', 't2', 's3', 's4')}) / nullif({det}, 0)"
    a1 = f"({det3('n', 't0', 's2', 's1', 't1', 's3', 's2', 't2', 's4')}) / nullif({det}, 0)"
    a2 = f"({det3('n', 's1', 't0', 's1', 's2', 't1', 's2', 's3', 't2')}) / nullif({det}, 0)"
    return f"""
WITH d AS (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM ({src}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
m AS (SELECT avg(x) AS mx, count(*) AS n FROM d),
s AS (SELECT CAST(any_value(n) AS DOUBLE) AS n, any_value(mx) AS mx, sum(x - mx) AS s1, sum((x - mx) * (x - mx)) AS s2,
             sum((x - mx) * (x - mx) * (x - mx)) AS s3, sum((x - mx) * (x - mx) * (x - mx) * (x - mx)) AS s4,
             sum(y) AS t0, sum((x - mx) * y) AS t1, sum((x - mx) * (x - mx) * y) AS t2 FROM d, m),
c AS (SELECT n, mx, {a0} AS a0, {a1} AS a1, {a2} AS a2 FROM s)
SELECT CAST(n AS BIGINT) AS n, a2 AS c2, a1 - 2 * a2 * mx AS c1, a0 - a1 * mx + a2 * mx * mx AS c0 FROM c WHERE n > 10"""


@query("quad_trend", "C7 P4", f"SELECT n, {R('c2')} AS c2, {R('c1')} AS c1, {R('c0')} AS c0 FROM ({_quad_sql(S.HOURLY, 'signup', 'view')})")
def quad_trend(spark, d):
    return correlation.quad_trend(D.hourly_wide(spark, d), "signup", "view")


@query("quad_curve", "C7", f"""
WITH q AS ({_quad_sql(S.HOURLY, 'signup', 'view')}),
r AS (SELECT CAST(min(signup) AS DOUBLE) AS lo, CAST(max(signup) AS DOUBLE) AS hi FROM ({S.HOURLY})),
g AS (SELECT CAST(unnest(range(0, 200)) AS INTEGER) AS i)
SELECT i, {R('lo + (hi - lo) * i / 199.0')} AS x,
       {R('c0 + c1 * (lo + (hi - lo) * i / 199.0) + c2 * (lo + (hi - lo) * i / 199.0) * (lo + (hi - lo) * i / 199.0)')} AS y_fit
FROM q, r, g""")
def quad_curve(spark, d):
    return correlation.quad_curve(D.hourly_wide(spark, d), "signup", "view")


@query("binned_extract", "C8", f"""
WITH d AS (SELECT season, CAST(signup AS DOUBLE) AS x, CAST(view AS DOUBLE) AS y FROM ({S.FINAL})
           WHERE signup IS NOT NULL AND view IS NOT NULL),
r AS (SELECT min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM d)
SELECT season,
  CAST(least(CASE WHEN xh = xl THEN 0 ELSE floor((x - xl) / ((xh - xl) / 50)) END, 49) AS INTEGER) AS x_bin,
  CAST(least(CASE WHEN yh = yl THEN 0 ELSE floor((y - yl) / ((yh - yl) / 50)) END, 49) AS INTEGER) AS y_bin,
  count(*) AS n, {R('avg(x)')} AS x_mean, {R('avg(y)')} AS y_mean
FROM d, r GROUP BY 1, 2, 3""")
def binned_extract(spark, d):
    return correlation.binned_scatter(D.final_table(spark, d), "signup", "view", ["season"], 50)


# ---------------------------------------------------------------- distributions

def _box_sql(src: str, value: str, group_expr: str, group_name: str, group_type: str = "") -> str:
    gsel = f"CAST({group_expr} AS {group_type})" if group_type else group_expr
    return f"""
WITH d AS (SELECT {gsel} AS {group_name}, CAST({value} AS DOUBLE) AS v FROM ({src}) WHERE {value} IS NOT NULL),
q AS (SELECT {group_name}, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3, avg(v) AS mean, count(*) AS n FROM d GROUP BY 1)
SELECT q.{group_name}, {R('q1')} AS q1, {R('median')} AS median, {R('q3')} AS q3, {R('mean')} AS mean, n,
  {R('min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))')} AS whisker_low,
  {R('max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))')} AS whisker_high,
  count(*) FILTER (WHERE NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS n_outliers
FROM d JOIN q USING ({group_name}) GROUP BY q.{group_name}, q1, median, q3, mean, n"""


@query("box_by_month", "G16", _box_sql("orders", "o_totalprice", "month(o_orderdate)", "month", "INTEGER"))
def box_by_month(spark, d):
    o = D.table(spark, d, "orders").select(F.month("o_orderdate").cast("int").alias("month"), "o_totalprice")
    return distribution.box_stats(o, "o_totalprice", ["month"], method="rank")


@query("box_by_season", "G17", _box_sql("orders", "o_totalprice", S.season_sql("month(o_orderdate)"), "season"))
def box_by_season(spark, d):
    o = features.calendar_features(D.table(spark, d, "orders"), "o_orderdate")
    return distribution.box_stats(o, "o_totalprice", ["season"], method="rank")


def _hist_sql(src: str, value: str, bins: int, group: str | None = None, density: bool = False) -> str:
    g = f"{group}, " if group else ""
    gj = f"USING ({group})" if group else "ON true"
    dens = (f", {R(f'CAST(coalesce(c.n, 0) AS DOUBLE) / (r.n_total * ((r.hi - r.lo) / {bins}))')} AS density"
            if density else "")
    return f"""
WITH d AS (SELECT {g}CAST({value} AS DOUBLE) AS v FROM ({src}) WHERE {value} IS NOT NULL),
r0 AS (SELECT {g}min(v) AS lo0, max(v) AS hi0, count(*) AS n_total, avg(v) AS mean, median(v) AS median FROM d
      {'GROUP BY ' + group if group else ''}),
r AS (SELECT *, CASE WHEN hi0 = lo0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
             CASE WHEN hi0 = lo0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM r0),
b AS (SELECT {g}CAST(least(CASE WHEN hi = lo THEN 0 ELSE floor((v - lo) / ((hi - lo) / {bins})) END, {bins - 1}) AS INTEGER) AS bin
      FROM d JOIN r {gj}),
c AS (SELECT {g}bin, count(*) AS n FROM b GROUP BY {'ALL'}),
dom AS (SELECT r.* EXCLUDE (lo0, hi0), CAST(unnest(range(0, {bins})) AS INTEGER) AS bin FROM r)
SELECT {'dom.' + group + ', ' if group else ''}dom.bin, {R(f'lo + (hi - lo) / {bins} * dom.bin')} AS bin_low,
       {R(f'lo + (hi - lo) / {bins} * (dom.bin + 1)')} AS bin_high, coalesce(c.n, 0) AS n, n_total,
       {R('mean')} AS mean, {R('median')} AS median{dens.replace('r.', 'dom.')}
FROM dom LEFT JOIN c ON dom.bin = c.bin {('AND dom.' + group + ' = c.' + group) if group else ''}"""


@query("histogram60", "G18", _hist_sql(S.HOURLY, "click", 60))
def histogram60(spark, d):
    return distribution.histogram(D.hourly_wide(spark, d), "click", 60)


@query("density_by_group", "G19", _hist_sql(S.FINAL, "click", 50, "inversion", density=True))
def density_by_group(spark, d):
    return distribution.histogram(D.final_table(spark, d), "click", 50, ["inversion"], density=True)


@query("profile_hour", "G20", f"""
SELECT CAST(hour(ts) AS INTEGER) AS hour, {_each(R('median({c})') + ' AS {c}', TYPES)} FROM ({S.HOURLY}) GROUP BY 1""")
def profile_hour(spark, d):
    h = D.hourly_wide(spark, d).withColumn("hour", F.hour("ts").cast("int"))
    return distribution.group_stat(h, TYPES, ["hour"], "median")


@query("profile_weekday", "G20", f"""
SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, {_each(R('median({c})') + ' AS {c}', TYPES)}
FROM ({S.HOURLY}) GROUP BY 1""")
def profile_weekday(spark, d):
    h = features.calendar_features(D.hourly_wide(spark, d), "ts").select("weekday", *TYPES)
    return distribution.group_stat(h, TYPES, ["weekday"], "median")


@query("profile_season_hour", "G21", f"""
SELECT season, hour, {R('median(click)')} AS click FROM ({S.FINAL}) GROUP BY 1, 2""")
def profile_season_hour(spark, d):
    return distribution.group_stat(D.final_table(spark, d), "click", ["season", "hour"], "median")


@query("monthly_flag_share", "G22", f"""
SELECT CAST(month(o_orderdate) AS INTEGER) AS month, {R("avg(CAST(o_orderstatus = 'F' AS INTEGER)) * 100")} AS share_pct,
       count(*) AS n FROM orders GROUP BY 1""")
def monthly_flag_share(spark, d):
    o = D.table(spark, d, "orders").select(F.month("o_orderdate").cast("int").alias("month"),
                                          (F.col("o_orderstatus") == "F").cast("int").alias("flag"))
    return distribution.flag_share(o, "flag", ["month"])


@query("seasonal_mean", "G23", f"""
SELECT season, {R('avg(o_totalprice)')} AS o_totalprice,
       CASE season WHEN 'Winter' THEN 0 WHEN 'Frühling' THEN 1 WHEN 'Sommer' THEN 2 WHEN 'Herbst' THEN 3 END AS season_order
FROM (SELECT {S.season_sql('month(o_orderdate)')} AS season, o_totalprice FROM orders) GROUP BY 1""")
def seasonal_mean(spark, d):
    o = features.calendar_features(D.table(spark, d, "orders"), "o_orderdate")
    g = distribution.group_stat(o, "o_totalprice", ["season"], "mean")
    return g.withColumn("season_order", season_ordinal("season"))


def _contrast_sql(src: str, value: str, flag: str, base: int) -> str:
    o = 1 - base
    return f"""
SELECT {R('mean_base')} AS mean_base, {R('mean_other')} AS mean_other, n_base, n_other,
       {R('mean_other - mean_base')} AS diff, {R('(mean_other - mean_base) * 100.0 / nullif(mean_base, 0)')} AS diff_pct
FROM (SELECT avg({value}) FILTER (WHERE {flag} = {base}) AS mean_base, avg({value}) FILTER (WHERE {flag} = {o}) AS mean_other,
             count({value}) FILTER (WHERE {flag} = {base}) AS n_base, count({value}) FILTER (WHERE {flag} = {o}) AS n_other
      FROM ({src}))"""


@query("group_contrast", "G24", _contrast_sql(S.FINAL, "click", "inversion", 0))
def group_contrast(spark, d):
    return distribution.two_group_contrast(D.final_table(spark, d), "click", "inversion", 0)


@query("rain_contrast", "G24", _contrast_sql(S.FINAL, "click", "rain", 1))
def rain_contrast(spark, d):
    return distribution.two_group_contrast(D.final_table(spark, d), "click", "rain", 1)


@query("sector_mean", "G25 J5 F12", f"""
WITH d AS (SELECT fmod(fmod(signup * 10, 360) + 360, 360) AS dir, CAST(click AS DOUBLE) AS v FROM ({S.FINAL})
           WHERE signup IS NOT NULL AND click IS NOT NULL),
g AS (SELECT CAST(CASE WHEN dir = 0 THEN 0 ELSE least(ceil(dir / 22.5) - 1, 15) END AS INTEGER) AS sector,
             avg(v) AS mean, count(*) AS n FROM d GROUP BY 1),
dom AS (SELECT CAST(unnest(range(0, 16)) AS INTEGER) AS sector)
SELECT dom.sector, {R('dom.sector * CAST(22.5 AS DOUBLE)')} AS deg_low, {R('(dom.sector + 1) * CAST(22.5 AS DOUBLE)')} AS deg_high,
       {R('coalesce(g.mean, 0.0)')} AS mean, coalesce(g.n, 0) AS n FROM dom LEFT JOIN g USING (sector)""")
def sector_mean(spark, d):
    f = D.final_table(spark, d)
    return distribution.sector_mean(f, F.pmod(F.col("signup") * 10, F.lit(360.0)), "click")


# ---------------------------------------------------------------- hypothesis tests

HYP_COLUMNS = {"precipitation": "purchase", "PM10": "click", "inversion_indikator": "inversion", "NO": "click",
               "temperature_2m": "signup", "O3": "view", "ist_rush_hour": "is_rush_hour", "NO2": "error"}


def _corr_stats_sql(src: str, a: str, b: str) -> str:
    """One row: n, r, t, rho, t_s for columns a, b of src."""
    return f"""
SELECT '{a}' AS var_a, '{b}' AS var_b, n, r, {t_from_r_sql('r', 'n')} AS t, rho, {t_from_r_sql('rho', 'n')} AS t_s FROM
 (SELECT count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, {pearson_sql(a, b)} AS r FROM ({src})),
 (SELECT {pearson_sql('rx', 'ry')} AS rho FROM (SELECT {avg_rank_sql('x')} AS rx, {avg_rank_sql('y')} AS ry
   FROM (SELECT round({a}, 6) AS x, round({b}, 6) AS y FROM ({src}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL)))"""


def _welch_stats_sql(src: str, flag: str, value: str) -> str:
    return f"""
SELECT n0, n1, mean0, mean1, var0, var1, mean1 - mean0 AS diff,
  (mean1 - mean0) / nullif(sqrt(var0 / n0 + var1 / n1), 0) AS t,
  (var0 / n0 + var1 / n1) * (var0 / n0 + var1 / n1)
    / nullif((var0 / n0) * (var0 / n0) / (n0 - 1) + (var1 / n1) * (var1 / n1) / (n1 - 1), 0) AS dof,
  CASE WHEN sqrt((var0 + var1) / 2.0) > 0 THEN (mean1 - mean0) / sqrt((var0 + var1) / 2.0) ELSE 0.0 END AS cohens_d
FROM (SELECT count({value}) FILTER (WHERE {flag} = 0) AS n0, count({value}) FILTER (WHERE {flag} = 1) AS n1,
             avg(CAST({value} AS DOUBLE)) FILTER (WHERE {flag} = 0) AS mean0,
             avg(CAST({value} AS DOUBLE)) FILTER (WHERE {flag} = 1) AS mean1,
             var_samp(CAST({value} AS DOUBLE)) FILTER (WHERE {flag} = 0) AS var0,
             var_samp(CAST({value} AS DOUBLE)) FILTER (WHERE {flag} = 1) AS var1 FROM ({src}))"""


@query("corr_test", "H1", f"""
WITH RECURSIVE st AS ({_corr_stats_sql(S.FINAL, 'purchase', 'click')}),
{pvalue_cte("SELECT 'r' AS id, t, n - 2 AS dof FROM st UNION ALL SELECT 's' AS id, t_s AS t, n - 2 AS dof FROM st")}
SELECT var_a, var_b, n, {R('r')} AS r, {R('t')} AS t, {R("(SELECT p FROM pv WHERE id = 'r')")} AS p,
       {R('rho')} AS rho, {R("(SELECT p FROM pv WHERE id = 's')")} AS p_rho FROM st""")
def corr_test(spark, d):
    return hypothesis.corr_test(D.final_table(spark, d), "purchase", "click", key=["ts"])


@query("welch_test", "H2", f"""
WITH RECURSIVE st AS ({_welch_stats_sql(S.FINAL, 'inversion', 'click')}),
{pvalue_cte("SELECT 'w' AS id, t, dof FROM st")}
SELECT n0, n1, {R('mean0')} AS mean0, {R('mean1')} AS mean1, {R('var0')} AS var0, {R('var1')} AS var1,
       {R('diff')} AS diff, {R('t')} AS t, {R('dof')} AS dof, {R('(SELECT p FROM pv)')} AS p, {R('cohens_d')} AS cohens_d
FROM st""")
def welch_test(spark, d):
    return hypothesis.welch_test(D.final_table(spark, d), "inversion", "click")


@query("cohens_d", "H3", f"""
SELECT n0, n1, {R('diff')} AS diff, {R('cohens_d')} AS cohens_d FROM ({_welch_stats_sql(S.FINAL, 'is_rush_hour', 'error')})""")
def cohens_d(spark, d):
    return hypothesis.welch_test(D.final_table(spark, d), "is_rush_hour", "error").select(
        "n0", "n1", "diff", "cohens_d")


def _verdict_sql(expected: str, effect: str, strength: str, threshold: float, skip: str = "false") -> str:
    direction = f"{effect} < 0" if expected == "negative" else f"{effect} > 0"
    return (f"CASE WHEN {skip} THEN 'n/a' "
            f"WHEN coalesce({direction}, false) AND coalesce(p < 0.05, false) AND coalesce(abs({strength}) >= {threshold}, false) "
            f"THEN 'confirmed' WHEN coalesce({direction}, false) AND coalesce(p < 0.05, false) THEN 'partly (weak)' "
            f"WHEN NOT coalesce({direction}, false) THEN 'not confirmed' ELSE 'partly (not significant)' END")


def _verdicts_sql() -> str:
    rows, src = [], []
    for h in hypothesis.HYPOTHESES:
        a, b = (HYP_COLUMNS[v] for v in h.variables)
        if h.method == "correlation":
            src.append(f"SELECT '{h.id}' AS id, t, n - 2 AS dof FROM ({_corr_stats_sql(S.FINAL, a, b)})")
            rows.append(f"SELECT '{h.id}' AS id, '{h.method}' AS method, '{h.expected}' AS expected, r AS effect, "
                        f"r AS strength, n, '{h.expected}' AS e2, 0.10 AS th, false AS skip "
                        f"FROM ({_corr_stats_sql(S.FINAL, a, b)})")
        else:
            src.append(f"SELECT '{h.id}' AS id, t, dof FROM ({_welch_stats_sql(S.FINAL, a, b)})")
            rows.append(f"SELECT '{h.id}' AS id, '{h.method}' AS method, '{h.expected}' AS expected, diff AS effect, "
                        f"cohens_d AS strength, n0 + n1 AS n, '{h.expected}' AS e2, 0.20 AS th, "
                        f"(n0 < 5 OR n1 < 5) AS skip FROM ({_welch_stats_sql(S.FINAL, a, b)})")
    verdict = " ".join(
        f"WHEN id = '{h.id}' THEN "
        + _verdict_sql(h.expected, "effect", "strength", 0.10 if h.method == "correlation" else 0.20,
                       "false" if h.method == "correlation" else "skip")
        for h in hypothesis.HYPOTHESES)
    return f"""
WITH RECURSIVE hs AS ({" UNION ALL ".join(rows)}),
{pvalue_cte(" UNION ALL ".join(src))},
v AS (SELECT hs.*, pv.p FROM hs LEFT JOIN pv USING (id))
SELECT id, method, expected, {R('effect')} AS effect, {R('p')} AS p, {R('strength')} AS strength, n,
       CASE {verdict} END AS verdict FROM v"""


@query("hypothesis_verdicts", "H4 H5 H7", _verdicts_sql())
def hypothesis_verdicts(spark, d):
    return hypothesis.evaluate(D.final_table(spark, d), hypothesis.HYPOTHESES, HYP_COLUMNS)


@query("verdict_tally", "H6", f"SELECT verdict, count(*) AS n FROM ({_verdicts_sql()}) GROUP BY 1")
def verdict_tally(spark, d):
    return hypothesis.tally(hypothesis.evaluate(D.final_table(spark, d), hypothesis.HYPOTHESES, HYP_COLUMNS))


# ---------------------------------------------------------------- quality

QCOLS = ["click", "error", "view", "purchase", "signup"]
# Plausibility ranges mapped onto the stand-in columns.
RULES = {"click": (0.0, 500.0), "error": (0.0, 300.0), "view": (0.0, 300.0), "purchase": (0.0, 150.0),
         "signup": (-30.0, 45.0)}


@query("missing_grade", "Q3", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, {R(f'(count(*) - count({c})) * 100.0 / count(*)')} AS null_pct, "
    f"CASE WHEN (count(*) - count({c})) * 100.0 / count(*) < 5 THEN 'ok' "
    f"WHEN (count(*) - count({c})) * 100.0 / count(*) < 20 THEN 'warn' ELSE 'fail' END AS grade FROM ({S.FINAL})"
    for c in QCOLS))
def missing_grade(spark, d):
    return quality.missing_grade(D.final_table(spark, d), QCOLS)


@query("plausibility", "Q4 G27", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {R(f'CAST(min({c}) AS DOUBLE)')} AS min_actual, {R(f'CAST(max({c}) AS DOUBLE)')} AS max_actual, "
    f"CAST({lo} AS DOUBLE) AS min_rule, CAST({hi} AS DOUBLE) AS max_rule, "
    f"coalesce(min({c}) >= {lo} AND max({c}) <= {hi}, false) AS ok FROM ({S.FINAL})" for c, (lo, hi) in RULES.items()))
def plausibility(spark, d):
    return quality.plausibility(D.final_table(spark, d), RULES)


_MERGE = f"""SELECT n_final, n_raw, n_final * 100.0 / n_raw AS merge_pct
FROM (SELECT (SELECT count(*) FROM ({S.FINAL})) AS n_final, (SELECT count(*) FROM ({S.AIR_SQL})) AS n_raw)"""


@query("merge_ratio", "Q5", f"""
SELECT n_final, n_raw, {R('merge_pct')} AS merge_pct, coalesce(merge_pct >= 80, false) AS ok FROM ({_MERGE})""")
def merge_ratio(spark, d):
    return quality.merge_ratio(D.final_table(spark, d), D.air_hourly(spark, d))


@query("key_uniqueness", "D7", f"""
SELECT n_rows, n_keys, n_rows = n_keys AS "unique"
FROM (SELECT count(*) AS n_rows, count(DISTINCT ts) AS n_keys FROM ({S.FINAL}))""")
def key_uniqueness(spark, d):
    return quality.key_uniqueness(D.final_table(spark, d), ["ts"])


def _checks_sql() -> str:
    comp = (f"SELECT 'system' AS dimension, 'time_completeness' AS \"check\", "
            f"count(DISTINCT date_trunc('hour', ts)) * 100.0 / (date_diff('hour', min(date_trunc('hour', ts)), "
            f"max(date_trunc('hour', ts))) + 1) AS value, 95.0 AS threshold FROM ({S.FINAL})")
    oks = " AND ".join(f"min({c}) >= {lo} AND max({c}) <= {hi}" for c, (lo, hi) in RULES.items())
    plaus = (f"SELECT 'content' AS dimension, 'plausibility' AS \"check\", "
             f"CASE WHEN coalesce({oks}, false) THEN 1.0 ELSE 0.0 END AS value, 1.0 AS threshold FROM ({S.FINAL})")
    merge = f"SELECT 'usage' AS dimension, 'merge_ratio' AS \"check\", merge_pct AS value, 80.0 AS threshold FROM ({_MERGE})"
    dtype = "SELECT 'presentation' AS dimension, 'numeric_types' AS \"check\", 1.0 AS value, 1.0 AS threshold"
    return (f"SELECT dimension, \"check\", CAST(value AS DOUBLE) AS value, CAST(threshold AS DOUBLE) AS threshold, "
            f"coalesce(value >= threshold, false) AS ok FROM ({comp} UNION ALL {plaus} UNION ALL {merge} UNION ALL {dtype})")


def _checks(spark, d):
    return quality.check_rows(D.final_table(spark, d), D.air_hourly(spark, d), "ts", RULES, QCOLS)


@query("quality_checks", "Q1 Q4 Q5", f"""
SELECT dimension, "check", {R('value')} AS value, threshold, ok FROM ({_checks_sql()})""")
def quality_checks(spark, d):
    return _checks(spark, d)


@query("quality_score", "Q9", f"SELECT count(*) FILTER (WHERE ok) AS passed, count(*) AS total FROM ({_checks_sql()})")
def quality_score(spark, d):
    return quality.quality_score(_checks(spark, d))


def _null_sql(table: str, src: str, cols) -> str:
    total = " + ".join(f"count(*) - count({c})" for c in cols)
    parts = [f"SELECT '{table}' AS subject, ({total}) * 100.0 / (count(*) * {len(cols)}) AS null_pct FROM ({src})"]
    parts += [f"SELECT '{table}.{c}', (count(*) - count({c})) * 100.0 / count(*) FROM ({src})" for c in cols]
    return " UNION ALL ".join(parts)


@query("quality_warnings", "Q10", f"""
SELECT dimension, "check", {R('value')} AS value, threshold, ok,
       CASE WHEN dimension = 'system' THEN 'warn' ELSE 'error' END AS severity FROM ({_checks_sql()}) WHERE NOT ok
UNION ALL SELECT 'content', 'null_share:' || subject, {R('null_pct')}, 20.0, false, 'warn'
FROM ({_null_sql('user_hourly', S.USER_HOURLY, TYPES)} UNION ALL {_null_sql('orders_daily', S.ORDERS_DAILY, D.PRIORITY_COLS)})
WHERE null_pct > 20""")
def quality_warnings(spark, d):
    return quality.quality_warnings(_checks(spark, d), quality.null_shares(D.user_hourly(spark, d), TYPES, "user_hourly"),
                                    quality.null_shares(D.orders_daily(spark, d), D.PRIORITY_COLS, "orders_daily"))


def _row_text_sql(times, doubles, others) -> str:
    parts = [f"CAST(epoch_us({c}) AS VARCHAR)" for c in times]
    parts += [f"CAST(CAST(round({c} + 5e-10, 6) AS DECIMAL(28,6)) AS VARCHAR)" for c in doubles]
    parts += [f"CAST({c} AS VARCHAR)" for c in others]
    return "concat_ws('|', " + ", ".join(f"coalesce({p}, '-')" for p in parts) + ")"


def _digest_sql(text: str) -> str:
    return f"count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)) AS VARCHAR) AS digest"


_DIGEST_OTHERS = ["hour", "weekday", "month", "season", "is_weekend", "is_rush_hour", "temp_category", "wind_category", "rain", "inversion"]
_DIGEST_DOUBLES = [*D.AIR, *D.WEATHER, "sunshine_h"]


@query("content_digest", "Q8", f"SELECT {_digest_sql(_row_text_sql(['ts'], _DIGEST_DOUBLES, _DIGEST_OTHERS))} FROM ({S.FINAL})")
def content_digest(spark, d):
    return quality.content_digest(D.final_table(spark, d).select("ts", *_DIGEST_DOUBLES, *_DIGEST_OTHERS))


# Two versions of the daily table: as it is, and with prices beyond the bounds nulled.
_CAPPED = ", ".join(f"CASE WHEN {c} > 250000 THEN NULL ELSE {c} END AS {c}" for c in D.PRIORITY_COLS)


def _monthly_digest_sql(src: str) -> str:
    return (f"SELECT year(ts) AS year, month(ts) AS month, {_digest_sql(_row_text_sql(['ts'], D.PRIORITY_COLS, []))} "
            f"FROM ({src}) GROUP BY 1, 2")


@query("changed_months", "Q8", f"""
WITH a AS ({_monthly_digest_sql(S.ORDERS_DAILY)}), b AS ({_monthly_digest_sql(f'SELECT ts, {_CAPPED} FROM ({S.ORDERS_DAILY})')})
SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, 'changed' AS change
FROM a JOIN b USING (year, month) WHERE a.n_rows <> b.n_rows OR a.digest <> b.digest""")
def changed_months(spark, d):
    old = D.orders_daily(spark, d).select("ts", *D.PRIORITY_COLS)
    new = old.selectExpr("ts", *_CAPPED.split(", "))
    parts = {"year": F.year("ts"), "month": F.month("ts")}
    return quality.changed_parts(quality.content_digest(old, parts), quality.content_digest(new, parts), list(parts))
