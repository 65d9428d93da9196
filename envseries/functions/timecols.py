"""Time handling expressions (floor, parse, localise, calendar parts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_to(c: str | Column, unit: str = "hour") -> Column:
    """Truncate to ``unit`` and keep a zone-less timestamp.

    ``date_trunc`` returns a session-zone timestamp; the session zone is UTC
    (``session.configure``), so the cast back to ``timestamp_ntz`` is exact.
    """
    return F.date_trunc(unit, _c(c)).cast("timestamp_ntz")


def parse_offset_ts(c: str | Column, fmt: str = "yyyy-MM-dd'T'HH:mmZ") -> Column:
    """Parse a timestamp carrying a UTC offset and return the UTC wall clock.

    ``2023-01-01T00:00+0100`` becomes ``2022-12-31 23:00:00`` (zone dropped).
    """
    return F.to_timestamp(_c(c), fmt).cast("timestamp_ntz")


def parse_naive_ts(c: str | Column, fmt: str | None = None) -> Column:
    """Parse a zone-less timestamp string as-is."""
    if fmt is None:
        return F.to_timestamp_ntz(_c(c))
    return F.to_timestamp_ntz(_c(c), F.lit(fmt))


def localize(c: str | Column, zone: str) -> Column:
    """Read a zone-less wall clock as local time in ``zone``; return UTC.

    Rules (spelled out, not left to the engine):
    * ambiguous wall clock (autumn fall-back hour) -> null;
    * non-existent wall clock (spring gap) -> the first instant after the
      gap (the transition instant, transitions are on the hour);
    * otherwise the unique instant.
    """
    x = _c(c).cast("timestamp_ntz")
    utc = F.to_utc_timestamp(x, zone)  # earlier offset for ambiguous
    back = F.from_utc_timestamp(utc, zone).cast("timestamp_ntz")
    later = F.from_utc_timestamp(utc + F.expr("INTERVAL 1 HOUR"), zone).cast("timestamp_ntz")
    return (
        F.when(x.isNull(), None)
        .when(back != x, F.date_trunc("hour", utc).cast("timestamp_ntz").cast("timestamp"))
        .when(later == x, None)
        .otherwise(utc)
    ).cast("timestamp_ntz")


def local_time(c: str | Column, zone: str) -> Column:
    """Wall clock in ``zone`` of a UTC instant (for calendar features)."""
    return F.from_utc_timestamp(_c(c).cast("timestamp"), zone).cast("timestamp_ntz")


# Season names and their months, as the reference labels them.
SEASONS = {
    12: "Winter", 1: "Winter", 2: "Winter",
    3: "Frühling", 4: "Frühling", 5: "Frühling",
    6: "Sommer", 7: "Sommer", 8: "Sommer",
    9: "Herbst", 10: "Herbst", 11: "Herbst",
}
SEASON_ORDER = ["Winter", "Frühling", "Sommer", "Herbst"]
RUSH_HOURS = [7, 8, 9, 17, 18, 19]


def season(month: str | Column) -> Column:
    m = _c(month)
    return (
        F.when(m.isin(12, 1, 2), "Winter")
        .when(m.isin(3, 4, 5), "Frühling")
        .when(m.isin(6, 7, 8), "Sommer")
        .when(m.isin(9, 10, 11), "Herbst")
    )


def season_sql(month: str) -> str:
    """SQL text of ``season`` for a month expression."""
    return (f"CASE WHEN {month} IN (12, 1, 2) THEN 'Winter' WHEN {month} IN (3, 4, 5) THEN 'Frühling' "
            f"WHEN {month} IN (6, 7, 8) THEN 'Sommer' WHEN {month} IN (9, 10, 11) THEN 'Herbst' END")


def season_ordinal(name: str | Column) -> Column:
    n = _c(name)
    expr = None
    for i, s in enumerate(SEASON_ORDER):
        expr = F.when(n == s, i) if expr is None else expr.when(n == s, i)
    return expr


def weekday0(c: str | Column) -> Column:
    """Day of week with Monday = 0 (``dayofweek`` has Sunday = 1)."""
    return F.weekday(_c(c)).cast("int")


def month_label(c: str | Column) -> Column:
    return F.date_format(_c(c), "MMM")


def date_label(c: str | Column) -> Column:
    return F.date_format(_c(c), "dd.MM.yyyy")
