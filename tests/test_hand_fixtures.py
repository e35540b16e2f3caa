"""Literal expectations for the quirks the synthetic tables do not exercise."""

import math

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import scalars as SC
from gradeflow.models import baselines as B
from gradeflow.operators import features as FT
from gradeflow.operators import flow as FL
from gradeflow.operators import ids as ID
from gradeflow.operators import prep as P
from gradeflow.operators import split as SP
from gradeflow.operators import stats as S


def test_latest_attempt_drops_null_grade_first(spark):
    df = spark.createDataFrame([("s1", "c1", 1, "B"), ("s1", "c1", 3, "A"), ("s1", "c1", 4, "W")],
                               "sid string, cid string, termnum int, grade string")
    g = df.withColumn("grdpts", SC.grade_points("grade")).where(F.col("grdpts").isNotNull())
    out = P.latest_per_key(g, ["sid", "cid"], ["termnum"]).collect()
    assert [(r.termnum, r.grdpts) for r in out] == [(3, 4.0)]


def test_idmap_null_key_gets_an_id(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "x"), ("a", "x")], "k1 string, k2 string")
    m = {(r.k1, r.k2): r.idx for r in ID.build_idmap(df, ["k1", "k2"]).collect()}
    assert m == {("a", "x"): 0, ("a", None): 1, ("b", "x"): 2}
    j = ID.map_ids(df, ID.build_idmap(df, ["k1", "k2"]), ["k1", "k2"], "id")
    assert sorted(r.id for r in j.collect()) == [0, 0, 1, 2]


def test_lags_use_previous_attended_term(spark):
    df = spark.createDataFrame([(1, "c", 2, 3.0, 3.0), (1, "d", 5, 2.0, 3.0), (1, "e", 6, 4.0, 3.0)],
                               "sid int, cid string, termnum int, grdpts double, chrs double")
    r = FT.student_terms(df).orderBy("termnum").collect()
    assert [x.lterm_gpa for x in r] == [None, 3.0, 2.0]
    assert [x.lterm_cum_gpa for x in r] == [None, 3.0, 2.5]
    assert [x.sterm for x in r] == [1, 2, 3]


def test_cold_start_labels(spark):
    df = spark.createDataFrame([("s1", "c1", 0), ("s1", "c2", 1), ("s2", "c1", 1), ("s2", "c2", 1), ("s1", "c1", 1)],
                               "sid string, cid string, termnum int")
    out = {(r.sid, r.cid, r.termnum): r.cs for r in FT.mark_cold_start(df).collect()}
    assert out == {("s1", "c1", 0): "csb", ("s1", "c2", 1): "csc", ("s2", "c1", 1): "css",
                   ("s2", "c2", 1): "csb", ("s1", "c1", 1): "ncs"}


def test_cold_start_semi_join(spark):
    tr = spark.createDataFrame([(1, 1), (2, 1)], "sid int, cid int")
    te = spark.createDataFrame([(1, 1), (1, 2), (3, 1)], "sid int, cid int")
    assert [(r.sid, r.cid) for r in P.remove_cold_start(tr, te).collect()] == [(1, 1)]


def test_mean_of_means_zero_fallback(spark):
    tr = spark.createDataFrame([("s1", "c1", 4.0), ("s1", "c2", 2.0), ("s2", "c1", 3.0)],
                               "sid string, cid string, grdpts double")
    te = spark.createDataFrame([("s1", "c1"), ("s3", "c1"), ("s3", "c9")], "sid string, cid string")
    out = {(r.sid, r.cid): r.pred for r in B.mean_of_means(tr, te).collect()}
    assert out[("s1", "c1")] == pytest.approx((3 + 3 + 3.5) / 3)
    assert out[("s3", "c1")] == pytest.approx((3 + 0 + 3.5) / 3)
    assert out[("s3", "c9")] == pytest.approx((3 + 0 + 0) / 3)


def test_clip_vs_pred(spark):
    df = spark.createDataFrame([(4.6, 4.0)], "pred double, grdpts double")
    r = S.with_error(df).first()
    assert r.pred == 4.6 and r.error == 0.0


def test_eval_all_row(spark):
    df = spark.createDataFrame([(1, 1.0), (1, -1.0), (2, 2.0)], "termnum int, error double")
    rows = {(r.is_all, r.termnum): r for r in S.eval_by(df).collect()}
    assert rows[(False, 1)].rmse == pytest.approx(1.0)
    assert rows[(False, 2)].rmse == pytest.approx(2.0)
    a = rows[(True, None)]
    assert a.rmse == pytest.approx(math.sqrt(2))
    assert a.mae == pytest.approx(4 / 3)
    assert a.mae_std == pytest.approx(math.sqrt(2) / 3)


def test_running_rmse(spark):
    df = spark.createDataFrame([(1, 1.0), (1, -1.0), (2, 2.0)], "termnum int, error double")
    r = FT.rmse_by_term(df).orderBy("termnum").collect()
    assert [x.rmse for x in r] == pytest.approx([1.0, 2.0])
    assert [x.running_rmse for x in r] == pytest.approx([1.0, math.sqrt(2)])


def test_filters_null_cohort_oddball(spark):
    df = spark.createDataFrame([(None, 1), (None, 9)], "cohort int, termnum int")
    out = {r.termnum: r.split for r in SP.split_data(df, ["0-1:0-4"]).collect()}
    assert out == {1: "train", 9: "test"}


def test_impute_train_only(spark):
    tr = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    te = spark.createDataFrame([(None,)], "x double")
    a, b, v = S.impute(tr, ["x"], "median", test=te)
    assert sorted(r.x for r in a.collect()) == [1.0, 2.0, 3.0]
    assert [r.x for r in b.collect()] == [2.0]


def test_impute_all_null_policy(spark):
    tr = spark.createDataFrame([(None, 1.0)], "x double, y double")
    with pytest.raises(ValueError):
        S.impute(tr, ["x"], all_null="raise")
    assert "x" not in S.impute(tr, ["x"], all_null="drop")[0].columns
    assert "x" in S.impute(tr, ["x"], all_null="ignore")[0].columns


def test_zscore_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    z, p = S.scale(df, ["a", "b"])
    assert sorted(r.a for r in z.collect()) == [-1.0, 1.0]
    assert [r.b for r in z.collect()] == [0.0, 0.0]
    back = S.unscale(z, p, ["a", "b"])
    assert sorted(r.a for r in back.collect()) == [1.0, 3.0]


def test_balance_weights(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (0,)], "y int")
    w = sorted(r.weight for r in FT.balance_weights(df, "y").collect())
    assert w == pytest.approx([1 / 3, 1 / 3, 1 / 3, 1.0])


def test_gap_labels(spark):
    seq = [(200970, "I"), (201010, "SC"), (201040, "N"), (201070, "N"), (201110, "N"), (201140, "N"), (201170, "SC")]
    df = spark.createDataFrame([(1, t, lab) for t, lab in seq], "id int, termbnr long, label string")
    out = [r.label for r in FL.label_gaps(df).orderBy("termbnr").collect()]
    assert out == ["I", "SC", "NS", "B", "B", "D", "SC"]


def test_edges(spark):
    seq = ["I", "SC", "NS", "SC", "B", "BU", "G"]
    df = spark.createDataFrame([(1, 201000 + i, lab) for i, lab in enumerate(seq)],
                               "id int, termbnr long, label string")
    out = [(r.src, r.dst) for r in FL.edges(df).orderBy("termbnr").collect()]
    assert out == [("I", "SC"), ("SC", "BU"), ("BU", "G")]


def test_terms(spark):
    df = spark.createDataFrame([(201070,), (201010,), (201040,)], "t int")
    r = df.select("t", SC.next_term("t").alias("n"), SC.prev_term("t").alias("p")).collect()
    got = {x.t: (x.n, x.p) for x in r}
    assert got == {201070: (201110, 201040), 201010: (201040, 200970), 201040: (201070, 201010)}


def test_course_level(spark):
    df = spark.createDataFrame([(" 310 ",), ("B-42",), ("",), (None,)], "c string")
    assert [r.l for r in df.select(SC.course_level("c").alias("l")).collect()] == [3, 4, None, None]


def test_onehot_shared_layout(spark):
    df = spark.createDataFrame([(0, 0, 1.5), (1, 2, 2.5), (1, None, 0.5)], "sid int, cid int, x double")
    layout = ID.shared_offsets([df], ["sid", "cid"])
    assert layout == {"offsets": {"sid": 0, "cid": 2}, "next": 5}
    enc = ID.encode_entries(df, ["sid", "cid"], ["x"], layout).collect()
    idx = [[e.idx for e in r.entries] for r in enc]
    assert idx == [[0, 2, 5], [1, 4, 5], [1, 5]]


def test_window_split(spark):
    df = spark.createDataFrame([(t,) for t in range(6)], "termnum int")
    tr, te = SP.window_split(df, 4, 2)
    assert sorted(r.termnum for r in tr.collect()) == [2, 3]
    assert [r.termnum for r in te.collect()] == [4]


def test_weighted_importance(spark):
    df = spark.createDataFrame([("f", 0.6, 10), ("f", 0.3, 20)], "feature string, importance double, test_count int")
    assert S.avg_importance(df).first().importance == pytest.approx(0.4)


def test_contiguous_ids_scalable_path(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    m = ID.build_idmap(df, ["k"])
    rows = sorted((r.k, r.idx) for r in m.collect())
    assert [i for _, i in rows] == list(range(1000))
    assert all(k == i for k, i in rows)
