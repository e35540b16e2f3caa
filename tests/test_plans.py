"""Physical plan properties that matter at scale."""

import __spark_entry__ as E

MID = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_engineer_has_no_python_or_cartesian(spark):
    p = _plan(E.queries()["engineer_features"](spark, MID))
    assert "CartesianProduct" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_is_pruned(spark):
    df = E.queries()["grade_counts"](spark, MID)
    p = _plan(df)
    # lineitem is read with the columns the view needs, not all of them
    assert "l_returnflag" not in p


def test_window_features_aggregate_before_windowing(spark):
    p = _plan(E.queries()["student_lag_features"](spark, MID))
    assert "HashAggregate" in p and "Window" in p
