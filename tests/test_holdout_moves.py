"""Held-out rows per user: rows are dealt once, and users that are spread over groups get the same labels."""

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import split as SP


@pytest.fixture(scope="module")
def rows(spark):
    got = [(u, f"c{i % 23}", i) for u in range(6) for i in range(40 if u == 0 else 2 * u)]
    got += [(None, "c1", 0), (None, None, 1), (None, "c2", 2), (0, None, 3), (0, None, 4), (3, "", 5)]
    return spark.createDataFrame(got, "sid long, cid string, n long").cache()


def labels(df):
    return sorted(map(str, df.collect()))


def test_spread_users_get_the_same_labels(rows, monkeypatch):
    want = labels(SP.holdout_k(rows, 3, seed=7))
    assert len(want) == rows.count() and sum("test" in r for r in want) == 5 * 3 + 2 + 3  # user 1 has two rows
    assert labels(SP.holdout_k(rows, 3, seed=7, salts=4)) == want
    monkeypatch.setattr(SP, "HEAVY", 2)
    assert labels(SP.holdout_k(rows, 3, seed=7)) == want


def test_rows_are_dealt_once(spark, rows):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        plan = SP.holdout_k(rows.select("*", F.lit("wide").alias("w")), 3)._jdf.queryExecution().executedPlan()
        moved = [p for p in plan.toString().splitlines() if "Exchange hashpartitioning" in p and "_salt" in p]
        kept = [p for p in plan.toString().splitlines() if "SortMergeJoin" in p]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(moved) == 2 and not kept  # the rows, and the same for the heavy users' candidates
