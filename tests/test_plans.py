"""Plan shape: no Python UDFs, pushdown and pruning reach the scan, one aggregate per child."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from caseload.operators.cases import build_cases
from caseload.operators.scoring import number_cases
from caseload.plans import catalog
from caseload.sources import adapters

from conftest import SF

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas")
SKIP = {n for n in catalog.QUERIES if n == "intake_stream" or n.endswith("_after_intake")}  # run a streaming query when called


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SKIP))
def test_no_python_in_plan(spark, name):
    text = plan(E.queries()[name](spark, SF))
    assert not any(n in text for n in PY_NODES), name


def test_scan_pruning_and_pushdown(spark):
    text = E.queries()["case_flags"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # lineitem is read for needs and damage with only the columns they use
    assert "l_extendedprice" not in text and "l_shipdate" not in text and "l_quantity" not in text


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_every_line_is_a_need_or_a_damage_record(spark, sf):
    d = f"/root/testdata/sf{sf}"
    t = adapters.case_tables(spark, d)
    assert t.needs.count() + t.damage.count() == spark.read.parquet(f"{d}/lineitem.parquet").count()


def test_unused_branches_are_dropped(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {n: plan(catalog.QUERIES[n](spark, SF)) for n in ("city_fallback", "member_counts", "damage_categories")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for name in ("city_fallback", "member_counts"):
        assert "lineitem" not in plans[name] and "l_orderkey" not in plans[name] and "Window" not in plans[name]
    assert "l_linestatus" not in plans["damage_categories"] and "Window" not in plans["damage_categories"]


def test_one_aggregate_per_child(spark):
    cases = build_cases(adapters.case_tables(spark, SF))
    optimized = cases._jdf.queryExecution().optimizedPlan().toString()
    # members: one aggregate; needs: one by (family, program), then one by family; damage: one aggregate
    assert optimized.count("Aggregate [") == 4
    assert "Window [" not in optimized


def test_numbering_has_no_global_window_over_rows(spark):
    cases = build_cases(adapters.case_tables(spark, SF))
    numbered = number_cases(cases)
    text = numbered._jdf.queryExecution().optimizedPlan().toString()
    # the offsets of the ranges are constants; positions come from the sorted partitions
    assert not [ln for ln in text.splitlines() if "Window [" in ln]


@pytest.mark.parametrize("name", ["caseload_stats", "stats_json", "fallback_stats"])
def test_statistics_scan_the_case_table_once(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert text.count("FileScan parquet") == 1 and "Subquery" not in text
    assert text.count("WindowGroupLimit") == 2  # the top cities are cut before and after the shuffle
