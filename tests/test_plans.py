"""Plan shape of every registered analysis at small scale: no cartesian
products or nested-loop joins, and no row-at-a-time Python UDF anywhere."""

import pytest

from gravis.plans import catalogue as E

from conftest import SF001

HEAVY = {"rf_predictions", "rf_importance", "rf_importance_rollup", "rf_threshold_metrics",
         "grid_search", "grid_search_inside", "model_comparison"}


@pytest.mark.parametrize("name", sorted(set(E.queries()) - HEAVY))
def test_plan_shape(spark, name):
    df = E.queries()[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_scan_prunes_columns(spark):
    """The monthly matrix needs three order columns; the scan reads only those."""
    df = E.queries()["severity_by_month"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" in plan and "o_orderstatus" in plan
    assert "o_totalprice" not in plan and "o_orderpriority" not in plan
