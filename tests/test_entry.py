"""Driver contract and oracle parity on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from tables import SF001

FAST = ["hourly_wide", "missing_hours", "dedupe_first", "interpolate_limit", "missingness_class",
        "pearson_matrix", "spearman_matrix", "lag_correlation", "sector_mean", "hypothesis_verdicts",
        "quality_checks", "histogram60", "box_by_season", "rolling7_centered", "final_table"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "ts" in df.columns


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.oracle_sql()) >= 80


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ["customer", "part", "orders", "lineitem", "events"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def _norm(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF001)
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    idx = [dcols.index(c) for c in sdf.columns]
    srows = sorted((tuple(_norm(x) for x in r) for r in sdf.collect()), key=repr)
    drows = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert srows == drows
