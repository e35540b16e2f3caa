"""Tables are read once however often a query comes back to them, and models travel without their summaries."""

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import __spark_entry__ as E
from gradeflow.models import ml as ML
from gradeflow.sources.fixtures import Fixture


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Forty students who take six courses over five years."""
    rnd, d = random.Random(3), tmp_path_factory.mktemp("tables")
    orders = [(k, k % 40, dt.date(1992 + k % 5, 1 + k % 12, 1)) for k in range(240)]
    lines = [(k, rnd.randrange(12), rnd.randrange(4), 1 + i, float(rnd.randint(1, 45)), 10.0 * i, 0.0, 0.0, dt.date(1998, 1, 1))
             for k, _, _ in orders for i in range(2)]
    tables = {
        "orders": (orders, "o_orderkey o_custkey o_orderdate"),
        "lineitem": (lines, "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_shipdate"),
        "part": ([(k, f"TYPE {k % 3}") for k in range(12)], "p_partkey p_type"),
        "supplier": ([(k, f"S{k}", k) for k in range(4)], "s_suppkey s_name s_nationkey")}
    for name, (rows, columns) in tables.items():
        pq.write_table(pa.table(dict(zip(columns.split(), map(list, zip(*rows))))), d / f"{name}.parquet")
    return str(d)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ratings_are_a_written_table(spark, folder):
    r = Fixture(spark, folder).ratings
    assert r.count() > 100 and "Join" not in plan(r)


@pytest.mark.parametrize("name", ["impute_fill", "zscore_joint", "scan_some_data", "error_distribution", "cls_svm_linear", "cls_adaboost"])
def test_statistics_do_not_go_back_to_the_tables(spark, folder, name):
    """No join of the engineered table is left beside what the statistics or the model are applied to."""
    df = E.queries()[name](spark, folder)
    assert df.count() and "l_orderkey" not in plan(df) and "Join LeftOuter, ((sid" not in plan(df)


def test_classes_are_weighted_without_a_shuffle_by_label(spark):
    df = spark.createDataFrame([(float(i % 5 == 0),) for i in range(50)], "label double")
    out = ML.balanced_weights(df)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["label"], r["_w"]) for r in out.collect()} == {(1.0, 1.0), (0.0, 0.25)}


@pytest.mark.parametrize("method", ["svm", "forest", "ovr", "stacked"])
def test_classifiers_run_where_the_session_has_observed_a_frame(spark, method):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    rows = [(float(i % 2), *[float(i % 2 + (i + j) % 3) for j in range(len(ML.FEATURES))]) for i in range(60)]
    df = spark.createDataFrame(rows, "label double, " + ", ".join(f"{f} double" for f in ML.FEATURES))
    m = {"svm": ML.svm_cls, "forest": lambda: ML.forest_cls(2, 2), "ovr": lambda: ML.ovr_forest(2),
         "stacked": lambda: ML.stacked_cls(n_estimators=2, num_trees=2, max_depth=2)}[method]()
    assert len(m(df, df).collect()) == 60
