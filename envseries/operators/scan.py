"""Order-dependent operators over (series, ts) without whole-series partitions.

A window partitioned by the series key alone puts a whole series into one
task; with one series holding a third of all rows that task is the job.
Every positional operator here is therefore a *segmented scan*:

1. rows are windowed per ``(series, time bucket)`` -- the local pass;
2. a summary row per bucket (row count, first/last non-null value with its
   local position) is aggregated on the same partitioning (no new shuffle);
3. a window over the *bucket* table -- one row per (series, bucket), tiny --
   carries offsets and the nearest non-null neighbours across bucket edges;
4. the carried values are joined back on ``(series, bucket)``.

Series and bucket are one struct column: a struct is never null itself, so the
join back is a plain equality that takes the rows as they lie after the
windows (a null-safe comparison of each key would exchange them once more),
and null keys are equal to each other.

The result is the exact positional semantics of a sequential scan (row
numbers, previous / next non-null value) at any series size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def _q(name: str) -> str:
    return f"`{name}`"


def _nn(v: str, p: str) -> str:
    """SQL: struct(p, v) when v is not null (a non-null marker with its position)."""
    return f"CASE WHEN {v} IS NOT NULL THEN named_struct('p', {p}, 'v', {v}) END"


KEY = "_key"


def _keyed(df: DataFrame, series: Sequence[str], ts: str, bucket: str) -> DataFrame:
    """Add ``_key`` = struct(series..., bucket), the unit of all windows below."""
    parts = [_q(s) for s in series] + [f"date_trunc('{bucket}', {_q(ts)}) AS _bk"]
    return df.selectExpr("*", f"struct({', '.join(parts)}) AS {KEY}")


def _buckets(rows: DataFrame, series: Sequence[str], aggs: Sequence) -> DataFrame:
    """One row per ``_key`` with ``aggs``; series and bucket also as columns, so that all windows share their exchange."""
    parts = [f"{KEY}.{_q(s)} AS {_q('_s_' + s)}" for s in series]
    return rows.groupBy(KEY).agg(*aggs).selectExpr("*", *parts, f"{KEY}._bk AS _b")


def _bucket_window(series: Sequence[str]) -> str:
    by = f"PARTITION BY {', '.join(_q('_s_' + s) for s in series)} " if series else ""
    return f"{by}ORDER BY _b"


def neighbours(df: DataFrame, series: Sequence[str], ts: str, cols: Sequence[str],
               bucket: str = "month") -> DataFrame:
    """Add positions and nearest non-null neighbours per column.

    Adds ``_pos`` (1-based row number within the series ordered by ``ts``),
    ``_n`` (rows in the series) and per column ``c``:
    ``_prev_c`` = struct(p, v) of the last non-null at or before the row,
    ``_next_c`` = struct(p, v) of the first non-null at or after the row.
    ``ts`` must be unique within a series (dedupe first, ``cleaning.dedupe_first``).

    ``bucket`` (a ``date_trunc`` unit) sets the unit of work: one (series,
    bucket) is one window partition, so pick it such that a bucket fits a
    task -- ``month`` for hourly tables (at most 744 rows per series and
    bucket), ``day`` / ``hour`` / ``minute`` for raw high-frequency rows.
    The bucket table has one row per (series, bucket).

    The many similar window expressions are written as SQL text (one parse
    each) and emitted in one projection per frame, so Spark evaluates them
    in a single Window operator per frame.
    """
    series = list(series)
    row_w = f"PARTITION BY {KEY} ORDER BY {_q(ts)}"
    d = _keyed(df, series, ts, bucket).selectExpr("*", f"row_number() OVER ({row_w}) AS _rn")
    prev_w = f"OVER ({row_w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    next_w = f"OVER ({row_w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    d = d.selectExpr("*", *[f"last({_nn(_q(c), '_rn')}, true) {prev_w} AS {_q('_lp_' + c)}" for c in cols],
                     *[f"first({_nn(_q(c), '_rn')}, true) {next_w} AS {_q('_ln_' + c)}" for c in cols])

    aggs = [F.expr("count(1) AS _cnt")]
    for c in cols:
        aggs += [F.expr(f"max({_nn(_q(c), '_rn')}) AS {_q('_bl_' + c)}"),
                 F.expr(f"min({_nn(_q(c), '_rn')}) AS {_q('_bf_' + c)}")]
    b = _buckets(d, series, aggs)

    bucket_w = _bucket_window(series)
    before = f"OVER ({bucket_w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = f"OVER ({bucket_w} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    whole = f"OVER ({bucket_w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    b = b.selectExpr("*", f"coalesce(sum(_cnt) {before}, 0) AS _off", f"sum(_cnt) {whole} AS _n")
    carried, wins = [], []
    for c in cols:
        bl, bf = _q("_bl_" + c), _q("_bf_" + c)
        wins += [f"last({_nn(bl + '.v', '_off + ' + bl + '.p')}, true) {before} AS {_q('_cp_' + c)}",
                 f"first({_nn(bf + '.v', '_off + ' + bf + '.p')}, true) {after} AS {_q('_cn_' + c)}"]
        carried += [f"_cp_{c}", f"_cn_{c}"]
    b = b.selectExpr(KEY, "_off", "_n", *wins)

    out = d.join(b, KEY)
    news = ["_off + _rn AS _pos"]
    for c in cols:
        lp, ln = _q("_lp_" + c), _q("_ln_" + c)
        news += [f"coalesce({_nn(lp + '.v', '_off + ' + lp + '.p')}, {_q('_cp_' + c)}) AS {_q('_prev_' + c)}",
                 f"coalesce({_nn(ln + '.v', '_off + ' + ln + '.p')}, {_q('_cn_' + c)}) AS {_q('_next_' + c)}"]
    drop = [KEY, "_rn", "_off"] + carried
    drop += [f"_lp_{c}" for c in cols] + [f"_ln_{c}" for c in cols]
    keep = [_q(c) for c in out.columns if c not in drop]
    return out.selectExpr(*keep, *news)


def _drop_helpers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop("_pos", "_n", *[f"_prev_{c}" for c in cols], *[f"_next_{c}" for c in cols])


def _replace(df: DataFrame, exprs: dict[str, str], cols: Sequence[str]) -> DataFrame:
    """Replace columns by SQL expressions in one projection, dropping helpers."""
    helpers = {"_pos", "_n", *[f"_prev_{c}" for c in cols], *[f"_next_{c}" for c in cols]}
    sel = [f"{exprs[c]} AS {_q(c)}" if c in exprs else _q(c) for c in df.columns if c not in helpers]
    return df.selectExpr(*sel)


def interpolate(df: DataFrame, series: Sequence[str], ts: str, cols: Sequence[str],
                limit: int = 3, mode: str = "limit", bucket: str = "month", circular: Sequence[str] = ()) -> DataFrame:
    """Positional linear interpolation of nulls.

    ``circular`` names those of ``cols`` that are directions in degrees: they
    go along the shorter arc (359 to 1 through 0, not 180) and stay in [0, 360).

    ``mode="limit"`` reproduces forward-direction limited interpolation: the
    first ``limit`` nulls after a value are filled (along the slope to the next
    value, or with the last value when none follows); leading nulls stay.
    ``mode="short_gaps"`` fills only gaps of at most ``limit`` nulls that have
    a value on both sides.
    """
    if mode not in ("limit", "short_gaps"):
        raise ValueError(f"unknown mode {mode!r}")
    d = neighbours(df, series, ts, cols, bucket)
    exprs = {}
    for c in cols:
        pr, nx = _q("_prev_" + c), _q("_next_" + c)
        way = f"({nx}.v - {pr}.v)"
        if c in circular:
            way = f"(pmod({way} + 180.0D, 360.0D) - 180.0D)"
        linear = f"{pr}.v + {way} * CAST(_pos - {pr}.p AS DOUBLE) / CAST({nx}.p - {pr}.p AS DOUBLE)"
        if c in circular:
            linear = f"pmod({linear}, 360.0D)"
        if mode == "limit":
            filled = (f"CASE WHEN {pr} IS NULL THEN NULL WHEN _pos - {pr}.p > {int(limit)} THEN NULL "
                      f"WHEN {nx} IS NULL THEN {pr}.v ELSE {linear} END")
        else:
            filled = (f"CASE WHEN {pr} IS NULL OR {nx} IS NULL THEN NULL "
                      f"WHEN {nx}.p - {pr}.p - 1 > {int(limit)} THEN NULL ELSE {linear} END")
        exprs[c] = f"coalesce({_q(c)}, CAST({filled} AS DOUBLE))"
    return _replace(d, exprs, cols)


def forward_fill(df: DataFrame, series: Sequence[str], ts: str, cols: Sequence[str],
                 limit: int | None = None, bucket: str = "month") -> DataFrame:
    """Carry the last non-null value forward (optionally at most ``limit`` rows)."""
    d = neighbours(df, series, ts, cols, bucket)
    exprs = {}
    for c in cols:
        pr = _q("_prev_" + c)
        fill = f"{pr}.v" if limit is None else f"CASE WHEN _pos - {pr}.p <= {int(limit)} THEN {pr}.v END"
        exprs[c] = f"coalesce({_q(c)}, {fill})"
    return _replace(d, exprs, cols)


def null_runs(df: DataFrame, series: Sequence[str], ts: str, cols: Sequence[str],
              bucket: str = "month") -> DataFrame:
    """Longest run of consecutive null rows per series and column.

    Returns ``series..., column, max_run`` (0 when a column has no null).
    Each null row knows the enclosing non-null neighbours, so its run length
    is ``next.p - prev.p - 1`` -- no gaps-and-islands window over the series.
    """
    series = list(series)
    d = neighbours(df, series, ts, cols, bucket)
    aggs = []
    for c in cols:
        start = F.coalesce(F.col(f"_prev_{c}.p"), F.lit(0))
        end = F.coalesce(F.col(f"_next_{c}.p"), F.col("_n") + 1)
        run = F.when(F.col(c).isNull(), end - start - 1)
        aggs.append(F.coalesce(F.max(run), F.lit(0)).cast("bigint").alias(c))
    wide = d.groupBy(*series).agg(*aggs)
    return wide.unpivot(series, list(cols), "column", "max_run") if series else \
        wide.unpivot([], list(cols), "column", "max_run")


def with_positions(df: DataFrame, series: Sequence[str], ts: str,
                   bucket: str = "month") -> DataFrame:
    """Only the row position ``_pos`` (1-based, per series by ``ts``)."""
    d = neighbours(df, series, ts, [], bucket)
    return d.drop("_n")


def with_halo(df: DataFrame, series: Sequence[str], ts: str, cols: Sequence[str], before: int = 0, after: int = 0,
              bucket: str = "month") -> DataFrame:
    """Each row with its place in its bucket and the values next to the bucket.

    Adds ``_rn`` and ``_bn`` (1-based row number within the bucket, rows of
    the bucket) and per column ``c`` the arrays ``_before_c`` / ``_after_c``:
    the last ``before`` values of the rows before the bucket and the first
    ``after`` values of those behind it, nulls included, in row order.

    A bucket hands on its outermost values, ``before`` + ``after`` of them;
    these travel over as many short buckets as it takes and come back with
    the bucket table.  The rows are exchanged once.
    """
    series = list(series)
    row_w = f"PARTITION BY {KEY} ORDER BY {_q(ts)}"
    d = _keyed(df, series, ts, bucket).selectExpr(
        "*", f"row_number() OVER ({row_w}) AS _rn", f"count(1) OVER (PARTITION BY {KEY}) AS _bn")
    edge = []
    for c in cols:
        own = f"named_struct('p', _rn, 'v', {_q(c)})"
        edge += [f"array_sort(collect_list(CASE WHEN _rn > _bn - {int(before)} THEN {own} END)) AS {_q('_t_' + c)}",
                 f"array_sort(collect_list(CASE WHEN _rn <= {int(after)} THEN {own} END)) AS {_q('_h_' + c)}"]
    b = _buckets(d, series, [F.expr(e) for e in edge])
    w = _bucket_window(series)
    carried = []
    for c in cols:
        # every bucket has a row, so ``before`` buckets hold enough of them
        last = f"flatten(collect_list({_q('_t_' + c)}) OVER ({w} ROWS BETWEEN {max(before, 1)} PRECEDING AND 1 PRECEDING)).v"
        first = f"flatten(collect_list({_q('_h_' + c)}) OVER ({w} ROWS BETWEEN 1 FOLLOWING AND {max(after, 1)} FOLLOWING)).v"
        carried += [f"{last} AS {_q('_t_' + c)}", f"{first} AS {_q('_h_' + c)}"]
    b = b.selectExpr(KEY, *carried)
    cut = []
    for c in cols:
        t, h = _q("_t_" + c), _q("_h_" + c)
        cut += [f"slice({t}, greatest(size({t}) - {int(before)}, 0) + 1, {int(before)}) AS {_q('_before_' + c)}",
                f"slice({h}, 1, {int(after)}) AS {_q('_after_' + c)}"]
    return d.join(b.selectExpr(KEY, *cut), KEY)


def lags(df: DataFrame, series: Sequence[str], ts: str, cols: dict[str, tuple[str, int]], bucket: str = "month") -> DataFrame:
    """Add ``name`` = value of ``column`` k rows earlier in the series, for every ``{name: (column, k)}``.

    All lags come from one window per bucket; the first rows of a bucket take
    theirs from what the buckets before it handed on.
    """
    most = max((k for _, k in cols.values()), default=0)
    d = with_halo(df, series, ts, sorted({c for c, _ in cols.values()}), before=most, bucket=bucket)
    new = []
    for name, (c, k) in cols.items():
        halo = f"try_element_at({_q('_before_' + c)}, CAST(_rn AS INT) - {k + 1})"
        new.append(f"{_q(c)} AS {_q(name)}" if k == 0 else
                   f"CASE WHEN _rn > {k} THEN lag({_q(c)}, {k}) OVER (PARTITION BY {KEY} ORDER BY {_q(ts)}) "
                   f"ELSE {halo} END AS {_q(name)}")
    return d.selectExpr(*[_q(c) for c in df.columns], *new)


def lag_rows(df: DataFrame, series: Sequence[str], ts: str, col: str, k: int,
             out: str | None = None, bucket: str = "month") -> DataFrame:
    """Value of ``col`` k rows earlier in the series (positional ``shift(k)``)."""
    return lags(df, series, ts, {out or f"{col}_lag{k}": (col, k)}, bucket)


def rolling_rows(df: DataFrame, series: Sequence[str], ts: str, col: str, before: int, after: int,
                 min_rows: int = 1, out: str = "rolling", bucket: str = "month") -> DataFrame:
    """Mean of the non-null values from ``before`` rows ahead of a row to ``after`` rows behind it.

    Null where fewer than ``min_rows`` values are there.  One window per
    bucket; its edges add what the buckets around it handed on.
    """
    d = with_halo(df, series, ts, [col], before, after, bucket)
    w = f"OVER (PARTITION BY {KEY} ORDER BY {_q(ts)} ROWS BETWEEN {int(before)} PRECEDING AND {int(after)} FOLLOWING)"
    left, right = _q("_before_" + col), _q("_after_" + col)
    lacking = f"greatest({int(before)} + 1 - CAST(_rn AS INT), 0)"  # rows of the window before the bucket
    ahead = f"slice({left}, greatest(size({left}) - {lacking}, 0) + 1, {lacking})"
    behind = f"slice({right}, 1, greatest({int(after)} - CAST(_bn - _rn AS INT), 0))"
    total = "aggregate({0}, 0.0D, (s, x) -> s + coalesce(x, 0.0D))"
    d = d.selectExpr(*[_q(c) for c in df.columns], f"sum({_q(col)}) {w} AS _s", f"count({_q(col)}) {w} AS _c",
                     f"transform(concat({ahead}, {behind}), x -> CAST(x AS DOUBLE)) AS _e")
    d = d.selectExpr(*[_q(c) for c in df.columns], f"coalesce(_s, 0.0D) + {total.format('_e')} AS _s",
                     "_c + size(filter(_e, x -> x IS NOT NULL)) AS _c")
    return d.selectExpr(*[_q(c) for c in df.columns], f"CASE WHEN _c >= {int(min_rows)} THEN try_divide(_s, _c) END AS {_q(out)}")
