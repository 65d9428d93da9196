"""Transition tables against the interpreter's own zone rules, and every rule for folds and gaps."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest

from envseries.operators import timeline, zones

CH = "Europe/Zurich"
H, M = dt.timedelta(hours=1), dt.timedelta(minutes=1)


def own(stamp, zone):
    """(kind, earlier, later) of a wall clock by trying both folds of the interpreter."""
    z = ZoneInfo(zone)
    a, b = (stamp.replace(tzinfo=z, fold=f).astimezone(dt.timezone.utc).replace(tzinfo=None) for f in (0, 1))
    back = a.replace(tzinfo=dt.timezone.utc).astimezone(z).replace(tzinfo=None)
    return ("plain" if a == b else "fold" if back == stamp else "gap"), a, b


@pytest.mark.parametrize("zone", [CH, "America/New_York", "Australia/Lord_Howe", "Asia/Kathmandu", "Africa/Casablanca", "UTC"])
def test_intervals_agree_with_the_interpreter(spark, zone):
    draw = random.Random(zone)
    stamps = [dt.datetime(1950, 1, 1) + M * draw.randrange(60 * 24 * 365 * 100) for _ in range(500)]
    for at, before, after in zones.transitions(zone):
        if 1950 < at.year < 2036:
            local = at + dt.timedelta(seconds=draw.choice([before, after]))
            stamps += [local + M * draw.randint(-90, 90), local]
    df = spark.createDataFrame([(s,) for s in set(stamps)], "ts timestamp_ntz")
    a = zones.localized(df, "ts", zone, "earlier", "earlier", "shift", "kind")
    rows = zones.localized(zones.localized(a, "ts", zone, "later", "later"), "ts", zone, "none").collect()
    assert len(rows) == len(set(stamps))
    for r in rows:
        kind, first, second = own(r.ts, zone)
        assert r.kind == kind, r
        if kind == "gap":
            assert r.earlier == first and r.later == r.none and first - H <= r.later <= first
        else:
            assert (r.earlier, r.later) == (first, second)
            assert r.none == (first if kind == "plain" else None)


def test_rules_at_both_transitions(spark):
    times = ["2023-03-26 01:59", "2023-03-26 02:00", "2023-03-26 02:30", "2023-03-26 03:00", "2023-10-29 01:59",
             "2023-10-29 02:00", "2023-10-29 02:59", "2023-10-29 03:00"]
    df = spark.createDataFrame([(dt.datetime.fromisoformat(t),) for t in times] + [(None,), (dt.datetime(1800, 1, 1),)], "ts timestamp_ntz")
    got = {r.ts: r.u for r in zones.localized(df, "ts", CH, "u").collect()}
    utc = lambda s: dt.datetime.fromisoformat(s)
    assert [got[dt.datetime.fromisoformat(t)] for t in times] == [
        utc("2023-03-26 00:59"), utc("2023-03-26 01:00"), utc("2023-03-26 01:00"), utc("2023-03-26 01:00"),
        utc("2023-10-28 23:59"), None, None, utc("2023-10-29 02:00")]
    assert got[None] is None and got[dt.datetime(1800, 1, 1)] is None
    nulls = {r.ts: r.u for r in zones.localized(df, "ts", CH, "u", gap="null").collect()}
    assert nulls[dt.datetime(2023, 3, 26, 2, 30)] is None
    with pytest.raises(ValueError):
        zones.localized(df, "ts", CH, fold="guess")


def test_fill_takes_the_row_before_the_fold(spark):
    """Per series, over years without rows, and nothing for a series that begins in a fold."""
    fold = dt.datetime(2023, 10, 29, 2)
    rows = [("a", dt.datetime(2021, 5, 1, 12)), ("a", fold), ("a", fold + 30 * M), ("a", dt.datetime(2023, 10, 29, 4)),
            ("b", fold + M), ("b", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 10, 27, 2, 30)),
            (None, dt.datetime(2023, 10, 29, 1, 30)), (None, fold), (None, None)]
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz")
    got = {(r.s, r.ts): r.u for r in timeline.localize_filled(df, "ts", CH, ["s"], "u").collect()}
    may = dt.datetime(2021, 5, 1, 10)
    assert got["a", fold] == got["a", fold + 30 * M] == may == got["a", rows[0][1]]
    assert got["b", fold + M] is None
    assert got["b", dt.datetime(2024, 10, 27, 2, 30)] == dt.datetime(2023, 12, 31, 23)
    assert got[None, fold] == dt.datetime(2023, 10, 28, 23, 30) and got[None, None] is None
    by_order = {(r.s, r.ts): r.u for r in timeline.localize_filled(
        df.filter("ts IS NOT NULL").selectExpr("*", "ts AS o"), "ts", CH, ["s"], "u", order="o").collect()}
    assert by_order == {k: v for k, v in got.items() if k[1]}


def test_hours_that_come_twice_by_order(spark):
    start = dt.datetime(2023, 10, 28, 22)
    instants = [start + H * i for i in range(8)]
    walls = [t.replace(tzinfo=dt.timezone.utc).astimezone(ZoneInfo(CH)).replace(tzinfo=None) for t in instants]
    df = spark.createDataFrame(list(enumerate(walls)), "i int, ts timestamp_ntz").repartition(3)
    got = [r.u for r in zones.localized_by_order(df, "ts", CH, "i", out="u").orderBy("i").collect()]
    assert got == instants
