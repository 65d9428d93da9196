"""Quality checks as tidy rows (dimension, check, subject, value, threshold, ok)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import null_profile
from .timeline import completeness


def missing_grade(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null share per column with grade: ok < 5 %, warn < 20 %, else fail (Q3)."""
    p = null_profile(df, cols, only_missing=False)
    grade = F.when(F.col("null_pct") < 5, "ok").when(F.col("null_pct") < 20, "warn").otherwise("fail")
    return p.withColumn("grade", grade)


def plausibility(df: DataFrame, rules: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Observed min / max against the rule range, ok flag."""
    cols = [c for c in rules if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, min_actual double, max_actual double, min_rule double, max_rule double, ok boolean")
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.expr(f"CAST(min(`{c}`) AS DOUBLE) AS _mn{i}"), F.expr(f"CAST(max(`{c}`) AS DOUBLE) AS _mx{i}")]
    row = df.agg(*aggs)
    parts = []
    for i, c in enumerate(cols):
        lo, hi = (float(x) for x in rules[c])
        parts.append(f"named_struct('column', '{c}', 'min_actual', _mn{i}, 'max_actual', _mx{i}, "
                     f"'min_rule', {lo!r}D, 'max_rule', {hi!r}D, "
                     f"'ok', coalesce(_mn{i} >= {lo!r}D AND _mx{i} <= {hi!r}D, false))")
    return row.selectExpr(f"inline(array({', '.join(parts)}))")


def merge_ratio(final: DataFrame, raw: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Final rows / raw rows in percent, ok >= threshold (Q5)."""
    a = final.agg(F.count(F.lit(1)).alias("n_final"))
    b = raw.agg(F.count(F.lit(1)).alias("n_raw"))
    r = a.crossJoin(b).withColumn("merge_pct", F.try_divide(F.col("n_final") * 100.0, F.col("n_raw")))
    return r.withColumn("ok", F.coalesce(F.col("merge_pct") >= threshold, F.lit(False)))


def join_quality(left: DataFrame, right: DataFrame, keys: Sequence[str], threshold: float = 80.0
                 ) -> DataFrame:
    """Rows of the inner join on ``keys`` / max(left, right) in percent and rows lost per side.

    The join itself isn't needed: rows are counted by key and side, and a key
    joins as many rows as the product of its two counts.  One aggregate over
    both sides, combined map-side.
    """
    both = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).union(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    known = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)  # null keys join nothing
    q = both.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")).agg(
        F.expr("coalesce(sum(_l), 0) AS n_left"), F.expr("coalesce(sum(_r), 0) AS n_right"),
        F.expr(f"coalesce(sum(CASE WHEN {known} THEN _l * _r END), 0) AS n_joined"))
    q = q.withColumn("match_pct", F.try_divide(F.col("n_joined") * 100.0,
                                                F.greatest("n_left", "n_right")))
    return (q.withColumn("lost_left", F.col("n_left") - F.col("n_joined"))
             .withColumn("lost_right", F.col("n_right") - F.col("n_joined"))
             .withColumn("warn", F.coalesce(F.col("match_pct") < threshold, F.lit(False))))


def key_uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and distinct keys: a join must keep (series, ts) unique."""
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    k = df.groupBy(*keys).count().agg(F.count(F.lit(1)).alias("n_keys"))
    return n.crossJoin(k).withColumn("unique", F.col("n_rows") == F.col("n_keys"))


def _row_text(df: DataFrame) -> str:
    """SQL text: a row as one string that any engine can write; doubles with 6 decimals, times as microseconds.

    Averages differ in their last digits with the order of the rows, hence the
    rounding, with the nudge of ``plans.registry``.
    """
    parts = []
    for c, kind in df.dtypes:
        x = f"`{c}`"
        if kind in ("double", "float"):
            x = f"CAST(round({x} + 5e-10D, 6) AS DECIMAL(28,6))"
        elif kind in ("timestamp", "timestamp_ntz"):
            x = f"unix_micros(CAST({x} AS TIMESTAMP))"
        parts.append(f"coalesce(CAST({x} AS STRING), '-')")
    return f"concat_ws('|', {', '.join(parts)})"


def content_digest(df: DataFrame, parts: Mapping[str, Column] | None = None) -> DataFrame:
    """Order-insensitive digest: row count and sum of row hashes (Q8), of the table or of each of its parts.

    ``parts`` maps names to expressions (a series, a month).  A digest is a
    sum, so the digests of parts add up to that of the table, and those of
    stored partitions need no second reading.  The hash is 60 bits of MD5,
    which other engines have too.
    """
    parts = dict(parts or {})
    h = f"CAST(conv(substr(md5({_row_text(df)}), 1, 15), 16, 10) AS DECIMAL(38,0))"
    d = df.select(*[e.alias(name) for name, e in parts.items()], F.expr(h).alias("_h"))
    return merged_digests(d.groupBy(*parts).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_h").cast("string").alias("digest")), list(parts))


def merged_digests(digests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n_rows, digest): digests of finer parts added up."""
    return digests.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.sum(F.col("digest").cast("decimal(38,0)")).cast("string").alias("digest"))


def changed_parts(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., change) of the parts that differ between two digests by part: added, removed or changed."""
    key = F.struct(*[F.col(b).alias(b) for b in by]).alias("_part")
    a = old.select(key, F.col("n_rows").alias("_n"), F.col("digest").alias("_d"))
    b = new.select(key, F.col("n_rows").alias("_m"), F.col("digest").alias("_e"))
    both = a.join(b, "_part", "full")
    change = "CASE WHEN _n IS NULL THEN 'added' WHEN _m IS NULL THEN 'removed' WHEN NOT (_n = _m AND _d <=> _e) THEN 'changed' END"
    return both.selectExpr(*[f"_part.`{c}` AS `{c}`" for c in by], f"{change} AS change").filter("change IS NOT NULL")


def check_rows(final: DataFrame, raw: DataFrame, ts: str, rules: Mapping[str, tuple[float, float]],
               measure_cols: Sequence[str], unit: str = "hour", series: Sequence[str] = ()
               ) -> DataFrame:
    """All checks as rows ``(dimension, check, value, threshold, ok)`` (Q9 / Q10 input).

    Without series keys every data check comes from ONE aggregate over the
    final table (time span, distinct periods, rows, per-rule min / max) and
    one count over the raw table.
    """
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    types_ok = all(t in numeric for c, t in final.dtypes if c in measure_cols)
    if not series:
        return _check_rows_one_pass(final, raw, ts, rules, unit, types_ok)
    comp = completeness(final, series, ts, unit).agg(  # the least complete series decides: one check, as without series
        F.lit("system").alias("dimension"), F.lit("time_completeness").alias("check"),
        F.min("completeness_pct").alias("value"), F.lit(95.0).alias("threshold"), F.coalesce(F.every("ok"), F.lit(False)).alias("ok"))
    plaus = plausibility(final, rules).agg(F.min(F.col("ok").cast("int")).alias("_ok"),
                                           F.count(F.lit(1)).alias("_n"))
    plaus = plaus.select(F.lit("content").alias("dimension"), F.lit("plausibility").alias("check"),
                         F.col("_ok").cast("double").alias("value"), F.lit(1.0).alias("threshold"),
                         F.coalesce(F.col("_ok") == 1, F.lit(True)).alias("ok"))
    merge = merge_ratio(final, raw).select(
        F.lit("usage").alias("dimension"), F.lit("merge_ratio").alias("check"),
        F.col("merge_pct").alias("value"), F.lit(80.0).alias("threshold"), "ok")
    dtype = final.sparkSession.range(1).select(
        F.lit("presentation").alias("dimension"), F.lit("numeric_types").alias("check"),
        F.lit(1.0 if types_ok else 0.0).alias("value"), F.lit(1.0).alias("threshold"),
        F.lit(types_ok).alias("ok"))
    return comp.unionByName(plaus).unionByName(merge).unionByName(dtype)


def _check_rows_one_pass(final: DataFrame, raw: DataFrame, ts: str, rules: Mapping[str, tuple[float, float]],
                         unit: str, types_ok: bool) -> DataFrame:
    sec = {"hour": 3600, "day": 86400, "minute": 60}[unit]
    p = f"CAST(date_trunc('{unit}', `{ts}`) AS TIMESTAMP_NTZ)"
    cols = [c for c in rules if c in final.columns]
    aggs = [F.expr(f"min({p}) AS _lo"), F.expr(f"max({p}) AS _hi"), F.expr(f"count(DISTINCT {p}) AS _np"),
            F.expr("count(1) AS _nf")]
    for i, c in enumerate(cols):
        aggs += [F.expr(f"CAST(min(`{c}`) AS DOUBLE) AS _mn{i}"), F.expr(f"CAST(max(`{c}`) AS DOUBLE) AS _mx{i}")]
    row = final.agg(*aggs).crossJoin(raw.agg(F.expr("count(1) AS _nr")))
    expected = (f"(CAST((unix_micros(CAST(_hi AS TIMESTAMP)) - unix_micros(CAST(_lo AS TIMESTAMP))) "
                f"/ {sec * 1_000_000} AS BIGINT) + 1)")
    comp = f"_np * 100.0D / {expected}"
    if cols:
        oks = " AND ".join(f"coalesce(_mn{i} >= {float(rules[c][0])!r}D AND _mx{i} <= {float(rules[c][1])!r}D, false)"
                           for i, c in enumerate(cols))
        plaus_v, plaus_ok = f"CASE WHEN {oks} THEN 1.0D ELSE 0.0D END", oks
    else:
        plaus_v, plaus_ok = "CAST(NULL AS DOUBLE)", "true"
    merge = "try_divide(_nf * 100.0D, _nr)"
    parts = [
        f"named_struct('dimension', 'system', 'check', 'time_completeness', 'value', {comp}, "
        f"'threshold', 95.0D, 'ok', {comp} >= 95.0D)",
        f"named_struct('dimension', 'content', 'check', 'plausibility', 'value', {plaus_v}, "
        f"'threshold', 1.0D, 'ok', {plaus_ok})",
        f"named_struct('dimension', 'usage', 'check', 'merge_ratio', 'value', {merge}, "
        f"'threshold', 80.0D, 'ok', coalesce({merge} >= 80.0D, false))",
        f"named_struct('dimension', 'presentation', 'check', 'numeric_types', 'value', "
        f"{1.0 if types_ok else 0.0!r}D, 'threshold', 1.0D, 'ok', {str(types_ok).lower()})",
    ]
    return row.selectExpr(f"inline(array({', '.join(parts)}))")


def quality_score(checks: DataFrame) -> DataFrame:
    """Number of passed checks out of all (Q9)."""
    return checks.agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"))


def quality_warnings(checks: DataFrame, *nulls: DataFrame, max_null_pct: float = 20.0) -> DataFrame:
    """Failed checks with a severity, and too many nulls in a table or column (Q10).

    ``nulls`` are frames of ``null_shares``; a share above ``max_null_pct`` is a warning.
    """
    out = checks.filter(~F.col("ok")).withColumn(
        "severity", F.when(F.col("dimension") == "system", "warn").otherwise("error"))
    for n in nulls:
        out = out.unionByName(n.filter(F.col("null_pct") > max_null_pct).select(
            F.lit("content").alias("dimension"), F.concat(F.lit("null_share:"), "subject").alias("check"),
            F.col("null_pct").alias("value"), F.lit(float(max_null_pct)).alias("threshold"), F.lit(False).alias("ok"),
            F.lit("warn").alias("severity")))
    return out


def null_shares(df: DataFrame, cols: Sequence[str], table: str) -> DataFrame:
    """(subject, null_pct): the share of null cells of the table and of each column, in one aggregate."""
    row = df.agg(F.expr("count(1) AS _n"), *[F.expr(f"count_if(`{c}` IS NULL) AS _z{i}") for i, c in enumerate(cols)])
    total = " + ".join(f"_z{i}" for i in range(len(cols)))
    structs = [f"named_struct('subject', '{table}', 'null_pct', try_divide(({total}) * 100.0D, _n * {len(cols)}))"]
    structs += [f"named_struct('subject', '{table}.{c}', 'null_pct', try_divide(_z{i} * 100.0D, _n))" for i, c in enumerate(cols)]
    return row.selectExpr(f"inline(array({', '.join(structs)}))")
