"""SQL twins of the stand-in frames, for the DuckDB oracle."""

from __future__ import annotations

from .standins import AIR, EVENT_TYPES, PRIORITIES, PRIORITY_COLS, WEATHER


def R(expr: str, nd: int = 6) -> str:
    """Round a double expression for order-insensitive comparison.

    Values are nudged by 5e-10 before rounding, identically on the Spark
    side (``registry.round_doubles``): a mean that lies exactly on a
    rounding tie would otherwise round differently depending on the
    floating-point summation order of each engine.
    """
    return f"round(({expr}) + 5e-10, {nd})"


def _pivot(params, names, src, ts, par, val, unit):
    sel = ", ".join(f"avg({val}) FILTER (WHERE {par} = '{p}') AS \"{n}\"" for p, n in zip(params, names))
    inlist = ", ".join(f"'{p}'" for p in params)
    return (f"SELECT CAST(date_trunc('{unit}', {ts}) AS TIMESTAMP) AS ts, {sel} "
            f"FROM {src} WHERE {par} IN ({inlist}) GROUP BY 1")


def hourly_wide(params=None) -> str:
    params = params or EVENT_TYPES
    return _pivot(params, params, "events", "ts", "event_type", "value", "hour")


USER_HOURLY = ("SELECT user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, "
               + ", ".join(f"avg(value) FILTER (WHERE event_type = '{t}') AS {t}" for t in EVENT_TYPES)
               + " FROM events WHERE event_type IN (" + ", ".join(f"'{t}'" for t in EVENT_TYPES)
               + ") GROUP BY 1, 2")
AIR_SQL = hourly_wide(AIR)
WEATHER_SQL = hourly_wide(WEATHER)
HOURLY = hourly_wide()
JOINED = f"SELECT a.ts, a.click, a.error, a.view, w.purchase, w.signup FROM ({AIR_SQL}) a JOIN ({WEATHER_SQL}) w USING (ts)"
ORDERS_DAILY = _pivot(PRIORITIES, PRIORITY_COLS, "orders", "o_orderdate", "o_orderpriority",
                      "o_totalprice", "day")


def season_sql(m: str) -> str:
    return (f"CASE WHEN {m} IN (12, 1, 2) THEN 'Winter' WHEN {m} IN (3, 4, 5) THEN 'Frühling' "
            f"WHEN {m} IN (6, 7, 8) THEN 'Sommer' WHEN {m} IN (9, 10, 11) THEN 'Herbst' END")


def bins_sql(x: str, edges, labels) -> str:
    parts = " ".join(f"WHEN {x} > {edges[i]} AND {x} <= {edges[i + 1]} THEN '{lab}'"
                     for i, lab in enumerate(labels))
    return f"CASE {parts} END"


# Final table: joined + features (signup = temperature / wind, purchase = precipitation /
# pressure / sunshine).  Quantiles over the whole column, as the feature operator.
FINAL = f"""
WITH j AS ({JOINED}),
q AS (SELECT quantile_cont(purchase, 0.75) AS qh, quantile_cont(signup, 0.25) AS ql FROM j)
SELECT j.*,
  CAST(hour(ts) AS INTEGER) AS hour,
  CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
  CAST(month(ts) AS INTEGER) AS month,
  {season_sql('month(ts)')} AS season,
  CAST(isodow(ts) - 1 >= 5 AS INTEGER) AS is_weekend,
  CAST(hour(ts) IN (7, 8, 9, 17, 18, 19) AS INTEGER) AS is_rush_hour,
  {bins_sql('signup', [-30, 0, 10, 20, 30, 50], ['Frost', 'Kalt', 'Mild', 'Warm', 'Heiss'])} AS temp_category,
  {bins_sql('signup', [0, 5, 20, 40, 300], ['Windstill', 'Leicht', 'Mässig', 'Stark'])} AS wind_category,
  CAST(coalesce(purchase > 0.1, false) AS INTEGER) AS rain,
  CAST(coalesce(purchase > q.qh AND signup < q.ql, false) AS INTEGER) AS inversion,
  purchase / 3600.0 AS sunshine_h
FROM j CROSS JOIN q
"""

WEATHER_NAMES = WEATHER
