"""Registered queries vs their DuckDB oracle on the smallest data folder."""

import pytest

import __spark_entry__ as E
from oracle import compare, duck

SMALL = "/root/testdata/sf0.001"
CHECK = ["engineer_features", "cold_start_label", "eval_by", "pred_mean_of_means", "idmap_sorted",
         "status_gaps", "status_edges", "encode_onehot_shared", "time_to_degree_stats", "split_min_instances"]


@pytest.mark.parametrize("name", CHECK)
def test_query_matches_oracle(spark, name):
    q, sql = E.queries()[name], E.oracle_sql()[name]
    ok, msg = compare(q(spark, SMALL).toPandas(), duck(sql, SMALL))
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "rmse" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
