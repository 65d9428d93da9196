"""Local wall clocks to UTC by a table of a zone's transitions.

A zone is a table of intervals of local time: ordinary ones with their UTC
offset, folds (hours that come twice) and gaps (hours that never come).
Stamps join it on their month and lie in exactly one interval of it, so each
rule is that of an interval and stated once.  The table covers the years
``FIRST`` to ``LAST`` whatever the data hold; its size is that of the
calendar, which bounds what is broadcast.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST, LAST = 1900, 2199
FOLD_RULES = ("null", "earlier", "later")
GAP_RULES = ("forward", "shift", "null")

_SCHEMA = ("_month int, _lo timestamp_ntz, _hi timestamp_ntz, _kind string, _offset int, _next int, "
           "_at timestamp_ntz, _seg int")


def _offset(zone: ZoneInfo, at: dt.datetime) -> int:
    return int(at.replace(tzinfo=dt.timezone.utc).astimezone(zone).utcoffset().total_seconds())


@lru_cache(maxsize=32)
def transitions(zone: str) -> tuple[tuple[dt.datetime, int, int], ...]:
    """(UTC instant, offset before, offset after) in seconds, in order; found day by day, then by halving the day."""
    z, out = ZoneInfo(zone), []
    at, end, day = dt.datetime(FIRST, 1, 1), dt.datetime(LAST + 1, 1, 1), dt.timedelta(days=1)
    before = _offset(z, at)
    while at < end:
        after = _offset(z, at + day)
        if after != before:
            lo, hi = 0, 86400
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if _offset(z, at + dt.timedelta(seconds=mid)) == before else (lo, mid)
            out.append((at + dt.timedelta(seconds=hi), before, after))
        at, before = at + day, after
    return tuple(out)


@lru_cache(maxsize=32)
def _intervals(zone: str) -> tuple[tuple, ...]:
    """Rows of ``_SCHEMA``; ordinary intervals are cut at months.  ``_seg`` counts the folds begun so far."""
    def sec(n: int) -> dt.timedelta:
        return dt.timedelta(seconds=n)

    rows, seg = [], 0
    start, offset = dt.datetime(FIRST, 1, 1), _offset(ZoneInfo(zone), dt.datetime(FIRST, 1, 1))

    def put(lo, hi, *rest):
        while lo < hi:
            month = dt.datetime(lo.year + lo.month // 12, lo.month % 12 + 1, 1)
            rows.append((lo.year * 12 + lo.month, lo, min(hi, month), *rest))
            lo = month

    for at, before, after in transitions(zone):
        lo, hi = sorted((at + sec(before), at + sec(after)))
        put(start, lo, "plain", offset, offset, None, seg)
        seg += after < before
        put(lo, hi, "fold" if after < before else "gap", before, after, at, seg)
        start, offset = hi, after
    put(start, dt.datetime(LAST + 1, 1, 1), "plain", offset, offset, None, seg)
    return tuple(rows)


def interval_table(spark: SparkSession, zone: str) -> DataFrame:
    """Intervals of local time (month, lo, hi, kind, offset, offset after, transition, segment): a few thousand rows."""
    return spark.createDataFrame(list(_intervals(zone)), _SCHEMA)


def _located(df: DataFrame, ts: str, zone: str) -> DataFrame:
    x = F.col(ts)
    there = interval_table(df.sparkSession, zone)
    return df.join(F.broadcast(there), (F.year(x) * 12 + F.month(x) == F.col("_month")) & (x >= F.col("_lo")) & (x < F.col("_hi")), "left")


def _instant(ts: str, fold: str, gap: str) -> str:
    def minus(offset: str) -> str:
        return f"timestampadd(SECOND, -{offset}, `{ts}`)"

    folds = {"null": "CAST(NULL AS TIMESTAMP_NTZ)", "earlier": minus("_offset"), "later": minus("_next")}
    gaps = {"null": folds["null"], "forward": "_at", "shift": minus("_offset")}
    return f"CASE _kind WHEN 'fold' THEN {folds[fold]} WHEN 'gap' THEN {gaps[gap]} WHEN 'plain' THEN {minus('_offset')} END"


def localized(df: DataFrame, ts: str, zone: str, out: str = "ts_utc", fold: str = "null", gap: str = "forward",
              kind: str | None = None) -> DataFrame:
    """Add the UTC instant of the wall clock ``ts`` (timestamp_ntz) in ``zone`` (T5).

    ``fold``: an hour that comes twice gives null, the ``earlier`` or the
    ``later`` instant; ``gap``: an hour that never comes gives the transition
    itself (``forward``), the same distance behind it (``shift``) or null.
    ``kind`` names a column for plain / fold / gap.  A null stamp, or one
    outside the years of the table, gives null.
    """
    if fold not in FOLD_RULES or gap not in GAP_RULES:
        raise ValueError(f"unknown rule: fold {fold!r}, gap {gap!r}")
    extra = [f"_kind AS `{kind}`"] if kind else []
    return _located(df, ts, zone).selectExpr(*[f"`{c}`" for c in df.columns], f"{_instant(ts, fold, gap)} AS `{out}`", *extra)


def localized_by_order(df: DataFrame, ts: str, zone: str, order: str, series: Sequence[str] = (),
                       out: str = "ts_utc") -> DataFrame:
    """As ``localized``, but an hour that a series reports twice is the earlier, then the later instant by ``order``.

    Only rows in folds are sorted.  An hour reported once is the earlier instant.
    """
    d = _located(df, ts, zone)
    keep = [f"`{c}`" for c in df.columns]
    twice = d.filter("_kind = 'fold'").withColumn("_turn", F.expr(
        f"row_number() OVER (PARTITION BY {', '.join(f'`{c}`' for c in [*series, ts])} ORDER BY `{order}`)"))
    plain = d.filter("_kind IS NULL OR _kind <> 'fold'").selectExpr(*keep, f"{_instant(ts, 'null', 'forward')} AS `{out}`")
    return plain.unionByName(twice.selectExpr(*keep, f"CASE WHEN _turn = 1 THEN {_instant(ts, 'earlier', 'forward')} "
                                                     f"ELSE {_instant(ts, 'later', 'forward')} END AS `{out}`"))


def localized_filled(df: DataFrame, ts: str, zone: str, series: Sequence[str] = (), out: str = "ts_utc") -> DataFrame:
    """As ``localized``; stamps in a fold take the instant of the row before, by wall clock, in their series.

    All rows of a fold have the same row before them: the last one ahead of
    the fold.  So nothing is sorted: the last instant of each series between
    two folds is an aggregate, carried on over stretches without rows, and
    only the rows in folds are joined to it.
    """
    d = _located(df, ts, zone)
    keep = [f"`{c}`" for c in df.columns]
    parts = ", ".join([*(f"`{s}`" for s in series), "_seg"])
    d = d.selectExpr(*keep, "_kind", f"{_instant(ts, 'null', 'forward')} AS _utc", f"struct({parts}) AS _stretch")
    by = f"PARTITION BY {', '.join(f'_stretch.`{s}`' for s in series)} " if series else ""
    last = d.groupBy("_stretch").agg(F.max("_utc").alias("_last")).selectExpr(
        "_stretch", f"max(_last) OVER ({by}ORDER BY _stretch._seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _ahead")
    folds = d.filter("_kind = 'fold'").join(last, "_stretch").selectExpr(*keep, f"_ahead AS `{out}`")
    return d.filter("_kind IS NULL OR _kind <> 'fold'").selectExpr(*keep, f"_utc AS `{out}`").unionByName(folds)
