"""Nothing is lost or changed without a trace."""

import math

import pytest
from pyspark.sql import functions as F

from gradeflow import session
from gradeflow.operators import split as SP
from gradeflow.plans import registry as R
from gradeflow.plans import rolling as RO
from gradeflow.sources import io as IO


def grid(spark, terms=12, cohorts=5):
    rows = [(f"s{c}", f"c{t}", c, t) for c in range(cohorts) for t in range(terms)] + [("sn", "c1", None, 7)]
    return spark.createDataFrame(rows, "sid string, cid string, cohort long, termnum long")


def test_filters_without_an_end(spark):
    assert SP.parse_filter("2:5") == ((2, None), (5, None))
    assert SP.parse_filter("0-1:0-4") == ((0, 1), (0, 4))
    assert SP.parse_filter("3-9") == ((3, 9), (0, None))
    for bad in ("", "a-b", "1-2-3", "-3", "1:2:3"):
        with pytest.raises(ValueError):
            SP.parse_filter(bad)
    out = SP.split_data(grid(spark, terms=20_000 // 10), ["2:5"])
    got = {(r["cohort"], r["termnum"]): r["split"] for r in out.collect()}
    # cohorts from 2 on, terms from 5 on; and oddballs up to the cohort it starts with
    assert all(s == ("train" if (c is not None and c >= 2 and t >= 5) or t <= 2 else "test") for (c, t), s in got.items())
    assert {"train", "test"} == set(got.values())
    ref = SP.split_data(grid(spark), ["2:5"], mode="reference")
    assert {r["split"] for r in ref.collect()} == {"train"}


def test_a_failing_split_raises_or_shows(spark):
    df = spark.createDataFrame([("u", f"i{t}", t, 3.0) for t in range(4)], "sid string, cid string, termnum long, grdpts double")

    def method(train, test):
        if test.first()["termnum"] == 2:
            raise OSError("disk on fire")
        return test.withColumn("pred", F.lit(2.0))

    with pytest.raises(OSError):
        RO.run_splits(SP.splits(df, "termnum"), method)
    out = {r["split_key"]: r for r in RO.run_splits(SP.splits(df, "termnum"), method, on_error="log").collect()}
    assert {k: r["status"].split(":")[0] for k, r in out.items()} == {"0": "skipped", "1": "ok", "2": "OSError", "3": "ok"}
    assert out["2"]["pred"] is None and out["3"]["pred"] == 2.0
    with pytest.raises(ValueError):
        RO.run_splits([], method)


def test_predictions_join_back_with_the_term(spark):
    df = spark.createDataFrame([("u", "i", 0, 1.0), ("u", "i", 1, 2.0), ("u", "i", 2, 3.0)],
                               "sid string, cid string, termnum long, grdpts double")
    out = RO.holdout_eval(df, lambda tr, te: te.withColumn("pred", F.col("termnum") * 1.0), 1)
    assert sorted((r["termnum"], r["pred"]) for r in out.collect()) == [(1, 1.0), (2, 2.0)]


def test_term_folders_of_any_width(spark, tmp_path):
    for t in ("term=100", "term=7"):
        spark.createDataFrame([(1.0,)], "importance double").write.parquet(str(tmp_path / "term3set" / t))
    out = IO.read_importances(spark, str(tmp_path / "term3set"))
    assert sorted(r["termnum"] for r in out.collect()) == [7, 100]


def test_rounding_shows_what_it_cannot_round(spark):
    import duckdb
    values = [float("nan"), float("inf"), float("-inf"), 1e15, -2e106, 2.0 ** 42, 0.1234567, -3.5, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    got = [r["v"] for r in R.round_doubles(df).orderBy("i").collect()]
    assert math.isnan(got[0]) and got[1:6] == values[1:6] and got[8] is None
    assert abs(got[6] - 0.1234567) < 1e-6 and got[7] == -3.5
    lit = ", ".join("(NULL)" if v is None else f"('{v!r}'::DOUBLE)" for v in values)
    sql = R.finalize_sql(f"SELECT v FROM (VALUES {lit}) t(v)", "/root/testdata/sf0.001")
    duck = [r[0] for r in duckdb.sql(sql).fetchall()]
    assert math.isnan(duck[0]) and duck[1:] == got[1:]


def test_null_features_never_leak(spark):
    train = spark.createDataFrame([("u", "seen", 0, 1, 1.0)], "sid string, cid string, termnum long, ord long, x double")
    test = spark.createDataFrame([("u", "new", 5, k, None) for k in range(5)] + [("u", "seen", 6, 9, None), (None, None, 6, 10, None)],
                                 train.schema)
    a, b = SP.seed_unseen_items(train, test, 3)
    left, right = {tuple(r) for r in a.collect()}, {tuple(r) for r in b.collect()}
    assert not left & right and a.columns == b.columns == test.columns
    assert len(left) == 1 + 3 + 1 and len(right) == 3


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Spark:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Spark())


def test_random_split_sizes(spark):
    df = spark.range(37).withColumn("k", F.col("id") % 5)
    for p in (0.0, 0.3, 0.999, 1.0):
        n = SP.random_split(df, p, seed=3, keys=["id"]).where("split = 'train'").count()
        assert n == min(37, int(37 * p + 1))
    assert SP.random_split(df.limit(0), 0.5).count() == 0
