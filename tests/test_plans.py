"""Plan-shape invariants: what the physical plans must (not) contain."""

import re

import pytest

from envseries.plans.catalog import REGISTRY
from tables import SF001

PYTHON_NODES = ["BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas",
                "MapInArrow", "PythonMapInArrow"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: _plan(e.build(spark, SF001)) for name, e in REGISTRY.items() if e.sql}


def test_no_python_and_no_cartesian_product(plans):
    for name, plan in plans.items():
        for node in PYTHON_NODES + ["CartesianProduct"]:
            assert node not in plan, f"{name} has {node}"


def test_pivot_pushes_filter_and_prunes_columns(plans):
    p = plans["hourly_wide"]
    assert "PushedFilters: [In(event_type" in p
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in p
    assert "partial_avg" in p


def test_segmented_scan_partitions_by_series_and_bucket(plans):
    p = plans["interpolate_by_series"]
    # rows are windowed per (series, bucket), one struct that is never null ...
    assert re.search(r"struct\(user_id, user_id#\d+L?, _bk, ", p) or "struct<user_id:bigint,_bk:timestamp>" in p
    assert re.search(r"hashpartitioning\(_key#\d+, \d+\)", p)
    # ... only the one-row-per-(series, bucket) summary is windowed per series
    assert not re.search(r"hashpartitioning\(user_id#\d+L?, \d+\)", p)


def test_dedupe_combines_map_side(plans):
    assert "partial_min" in plans["dedupe_first"]


def test_raw_box_stats_do_not_buffer_values(plans):
    for name in ("box_by_month", "box_by_season"):
        assert "percentile(" not in plans[name]
