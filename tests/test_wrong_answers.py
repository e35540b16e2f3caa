"""Cases that once gave wrong answers or crashed."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeflow.models import baselines as B
from gradeflow.models import ml as ML
from gradeflow.operators import features as FT
from gradeflow.operators import split as SP
from gradeflow.plans import rolling as RO


def test_each_user_holds_out_items_of_their_own(spark):
    df = spark.createDataFrame([(u, f"c{i}") for u in range(200) for i in range(20)], "sid long, cid string")
    held = SP.holdout_k(df, 3).where("split = 'test'").collect()
    assert Counter(r["sid"] for r in held) == {u: 3 for u in range(200)}
    per_item = Counter(r["cid"] for r in held)
    assert len(per_item) == 20 and max(per_item.values()) < 60


def test_holdout_of_repeated_pairs_and_null_users(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "a", 3), (None, "a", 4), (None, "b", 5), (2, None, 6)],
                               "sid long, cid string, n int")
    out = SP.holdout_k(df, 1)
    assert out.columns == ["sid", "cid", "n", "split"] and out.count() == 6
    held = out.where("split = 'test'").collect()
    assert Counter(r["sid"] for r in held) == {1: 1, 2: 1, None: 1}


def test_rolling_leaves_out_rows_without_a_term(spark):
    df = spark.createDataFrame([(1, "a", 0, 3.0), (1, "b", 1, 2.0), (2, "a", None, 1.0)], "sid long, cid string, termnum long, grdpts double")
    assert [r["termnum"] for r in RO.rolling_eval(df, B.mean_of_means).collect()] == [1]


@pytest.mark.parametrize("first", [0, 1100, 201010])
def test_decayed_gpa_for_any_term_numbers(spark, first):
    rows = [("s", first, 1.0, 4.0), ("s", first + 1, 1.0, 2.0), ("s", first + 3, 2.0, 3.0), ("s", None, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "sid string, termnum long, chrs double, grdpts double")
    got = [r["tw_gpa"] for r in FT.decay_weighted_gpa(df).orderBy("termnum").collect()]
    assert got[0] is None and got[1] == 4.0 and abs(got[2] - (4 * .125 + 2 * .25) / (.125 + .25)) < 1e-12


@pytest.mark.parametrize("make", [ML.svm_cls, ML.stacked_cls, lambda: ML.knn_cls(1, features=["chrs"]), ML.fm_classify, ML.extra_trees_cls])
def test_one_class_is_skipped(spark, make):
    method = make()
    df = spark.createDataFrame([(i, 0.0, *[float(i)] * len(ML.FEATURES), i) for i in range(4)],
                               "sid long, label double, " + ", ".join(f"{f} double" for f in ML.FEATURES) + ", ord long")
    out = method(df, df)
    assert "prediction" in out.columns and out.count() == 0


def test_knn_weights(spark):
    train = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0), (2, 3.0, 4.0), (3, None, 2.0)], "ord long, chrs double, grdpts double")
    test = spark.createDataFrame([(1, 0.5), (2, 0.0), (2, 0.0), (3, 2.0)], "sid long, chrs double")

    def pred(k, weights):
        return {r["sid"]: r["pred"] for r in ML.knn(k, weights, ["chrs"])(train, test).collect()}
    assert pred(1, "uniform") == {1: 0.0, 2: 0.0, 3: 1.0}  # ties go to the smaller key
    assert pred(2, "distance")[2] == 1.0  # both rows at no distance (a missing feature counts as 0)
    assert abs(pred(2, "distance")[3] - 2.5) < 1e-12 and pred(9, "uniform")[1] == 1.75
    assert ML.knn(2, features=["chrs"])(train, test).count() == 4
    label = train.withColumn("label", (F.col("grdpts") > 1).cast("double"))
    assert {r["sid"]: r["prediction"] for r in ML.knn_cls(1, features=["chrs"])(label, test).collect()} == {1: 0.0, 2: 0.0, 3: 0.0}
