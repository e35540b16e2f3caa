"""Searches from Gram matrices against models fitted one by one; factorization machines on planted data."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeflow.models import ml as ML
from gradeflow.models.gram import linear_search
from gradeflow.operators.stats import metrics
from gradeflow.plans import rolling as RO


def table(spark, missing=False, n=400, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.normal(size=3)
        y = float(np.clip(2 + x[0] - 0.5 * x[1] + rng.normal() * 0.3, 0, 4))
        cells = [None if missing and rng.random() < 0.2 else float(v) for v in x]
        rows.append((i, f"c{i % 9}", int(rng.integers(0, 5)), y, *cells))
    return spark.createDataFrame(rows, "sid long, cid string, termnum long, grdpts double, a double, b double, c double"), rows


def test_equals_the_rolling_evaluation(spark):
    df, _ = table(spark)
    subsets = [("a", "b"), ("c",)]
    got = {(r["features"], r["l2"], r["window"]): (r["rmse"], r["n"]) for r in linear_search(
        df, ["a", "b", "c"], subsets, [0.0, 5.0], [None, 2]).collect()}
    assert len(got) == 8
    for s, window in itertools.product(subsets, [None, 2]):
        m = metrics(RO.rolling_eval(df, ML.linear(features=s, scale=False), window=window)).first()
        rmse, n = got[",".join(s), 0.0, window]
        assert abs(rmse - m["rmse"]) < 1e-9 and n == m["n"]


def test_missing_values_ridge_and_windows_against_numpy(spark):
    df, rows = table(spark, missing=True)
    df = df.unionByName(df.limit(3).withColumn("grdpts", F.lit(None).cast("double"))).unionByName(
        df.limit(3).withColumn("termnum", F.lit(None).cast("long")))
    got = {(r["features"], r["l2"], r["window"]): r["rmse"] for r in linear_search(df, ["a", "b", "c"], [("a", "c")], [7.0], [None, 1]).collect()}
    for window in (None, 1):
        errors = []
        for t in range(1, 5):
            past = [r for r in rows if r[2] < t and (window is None or r[2] >= t - window)]
            x = np.array([[r[4], r[6]] for r in past], dtype=float)
            mean = np.nanmean(x, axis=0)
            x = np.where(np.isnan(x), mean, x)
            y = np.array([r[3] for r in past])
            xc = x - x.mean(0)
            w = np.linalg.solve(xc.T @ xc + 7 * np.eye(2), xc.T @ (y - y.mean()))
            for r in rows:
                if r[2] == t:
                    v = np.where(np.isnan(np.array([r[4], r[6]], dtype=float)), mean, np.array([r[4], r[6]], dtype=float))
                    errors.append(r[3] - min(4, max(0, y.mean() + (v - x.mean(0)) @ w)))
        assert abs(got["a,c", 7.0, window] - np.sqrt(np.mean(np.square(errors)))) < 1e-9


def test_search_edges(spark):
    empty = spark.createDataFrame([], "termnum long, grdpts double, a double")
    assert [(r["rmse"], r["n"]) for r in linear_search(empty, ["a"]).collect()] in ([], [(None, 0)])
    flat = spark.createDataFrame([(t, 1.0 + t, None) for t in range(3)] * 2, "termnum long, grdpts double, a double")
    r = linear_search(flat, ["a"]).first()  # nothing known of the feature: the mean of the earlier terms
    assert r["n"] == 4 and abs(r["rmse"] - np.sqrt((1 + 1.5 ** 2) / 2)) < 1e-9


def interactions(spark, seed=5):
    """Ratings whose user x item part has no additive share."""
    rng = np.random.default_rng(seed)
    u, v = rng.normal(size=(60, 2)), rng.normal(size=(30, 2))
    rows = []
    for i in range(60):
        for j in range(30):
            if rng.random() < 0.6:
                x = float(rng.normal())
                y = float(np.clip(2 + 0.6 * u[i] @ v[j] + 0.3 * x + 0.02 * rng.normal(), 0, 4))
                rows.append((i, f"c{j}", 10 * int(rng.random() < 0.2), y, float(y > 2), x))
    df = spark.createDataFrame(rows, "sid long, cid string, termnum long, grdpts double, label double, x double")
    return df.where("termnum = 0"), df.where("termnum = 10")


def test_fm_finds_interactions(spark):
    train, test = interactions(spark)
    report = {}
    out = ML.fm_regress(dim=2, ridge=0.1, sweeps=10, features=["x"], report=report)(train, test)
    rmse = out.agg(F.sqrt(F.avg((F.col("pred") - F.col("grdpts")) ** 2))).first()[0]
    plain = test.agg(F.stddev_pop("grdpts")).first()[0]
    assert rmse < 0.45 * plain
    assert all(a >= b - 1e-9 for a, b in zip(report["loss"], report["loss"][1:]))
    unseen = test.limit(1).withColumn("sid", F.lit(-1).cast("long")).withColumn("cid", F.lit(None).cast("string"))
    assert 0 <= ML.fm_regress(dim=2, sweeps=1, features=["x"])(train, unseen).first()["pred"] <= 4


def test_fm_tells_classes_apart(spark):
    train, test = interactions(spark)
    report = {}
    out = ML.fm_classify(dim=2, ridge=0.5, sweeps=12, tol=1e-3, features=["x"], report=report)(train, test).collect()
    right = np.mean([r["prediction"] == r["label"] for r in out])
    assert right > 0.85 and all(0 <= r["p1"] <= 1 for r in out)
    assert report["loss"][-1] < report["loss"][0]
    assert ML.fm_classify(features=["x"])(train.where("label = 1"), test).count() == 0


@pytest.mark.parametrize("method", ["reg_ridge", "tree", "forest", "ada"])
def test_planted_line_for_other_regressions(spark, method):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(ML.FEATURES)))
    y = np.clip(2 + 0.8 * x[:, 0] - 0.4 * x[:, 1] + 0.05 * rng.normal(size=400), 0, 4)
    df = spark.createDataFrame([(i % 20, f"c{i % 7}", 10 * int(i % 4 == 0), float(y[i]), *map(float, x[i])) for i in range(400)],
                               "sid long, cid string, termnum long, grdpts double, " + ", ".join(f"{f} double" for f in ML.FEATURES))
    train, test = df.where("termnum = 0"), df.where("termnum = 10")
    m = {"reg_ridge": lambda: ML.linear(l2=1.0), "tree": lambda: ML.tree(5), "forest": lambda: ML.forest(20, 6),
         "ada": lambda: ML.adaboost_r2(6, 4)}[method]()
    rmse = m(train, test).agg(F.sqrt(F.avg((F.col("pred") - F.col("grdpts")) ** 2))).first()[0]
    assert rmse < 0.65 * test.agg(F.stddev_pop("grdpts")).first()[0]


def classes(spark, n=600, seed=4):
    """Label 1 inside a band of the first feature, with features that say nothing."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(ML.FEATURES)))
    y = (x[:, 0] + 0.8 * x[:, 1] > 0.2).astype(float)
    df = spark.createDataFrame([(i, 10 * int(i % 4 == 0), float(y[i]), *map(float, x[i])) for i in range(n)],
                               "sid long, termnum long, label double, " + ", ".join(f"{f} double" for f in ML.FEATURES))
    return df.where("termnum = 0"), df.where("termnum = 10")


@pytest.mark.parametrize("method", ["forest", "extra", "ada", "gboost", "svm", "stacked", "ovr", "gmm"])
def test_classifiers_on_separable_data(spark, method):
    train, test = classes(spark)
    m = {"forest": lambda: ML.forest_cls(20, 6), "extra": lambda: ML.extra_trees_cls(30, 7), "ada": lambda: ML.adaboost_samme(8, 2),
         "gboost": lambda: ML.gboost_cls(15), "svm": ML.svm_cls, "stacked": ML.stacked_cls, "ovr": lambda: ML.ovr_forest(10),
         "gmm": lambda: ML.gmm_cls(8)}[method]()
    out = m(train, test).collect()
    right = np.mean([r["prediction"] == r["label"] for r in out])
    assert len(out) == test.count() and right > (0.6 if method == "gmm" else 0.8), right


def test_one_level_of_random_thresholds_is_the_plain_one(spark):
    """A stump: the split with the lowest impurity among the drawn ones, with counts of all rows."""
    from gradeflow.models import extra_trees as X
    rng = np.random.default_rng(8)
    x, c, w = rng.normal(size=(200, 4)), rng.integers(0, 3, 200), rng.uniform(0.5, 2, 200)
    rows = spark.createDataFrame([(list(map(float, a)), int(b), float(d)) for a, b, d in zip(x, c, w)], "x array<double>, c int, w double")
    forest = X.grow(rows.repartition(5), 4, 3, trees=6, depth=1, draws=4, seed=1)
    assert len({(f, t) for f, t in zip(forest.feature[:, 0], forest.threshold[:, 0])}) == 6  # own thresholds
    draw = np.random.default_rng(1)
    order = np.argsort(draw.random((6, 1, 4)), axis=2)
    lo, hi = x.min(0)[order], x.max(0)[order]
    cut = lo + draw.random(lo.shape) * (hi - lo)
    for t in range(6):
        def impurity(d):
            right = x[:, order[t, 0, d]] > cut[t, 0, d]
            return sum(X.gini(np.bincount(c[s], w[s], 3)) for s in (right, ~right))
        best = min(range(4), key=impurity)
        assert forest.feature[t, 0] == order[t, 0, best] and abs(forest.threshold[t, 0] - cut[t, 0, best]) < 1e-12
        right = x[:, order[t, 0, best]] > cut[t, 0, best]
        assert np.allclose(forest.weights[t, 2], np.bincount(c[right], w[right], 3))


def test_eps_insensitive_reaches_the_best_line(spark):
    """One feature: some best line runs through two points moved by +-eps; few passes find its objective."""
    rng = np.random.default_rng(9)
    x = np.arange(16) / 4.0
    y = np.clip(1 + 0.7 * x + rng.normal(size=16) * 0.4, 0, 4)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "chrs double, grdpts double")
    report = {}
    eps, c = 0.1, 1e6
    out = ML.eps_insensitive(eps, c, features=["chrs"], report=report)(df, df).collect()

    def loss(p):
        return np.maximum(np.abs(y - p) - eps, 0).mean()
    best = min(loss(a + (b - a) * (x - x[i]) / (x[j] - x[i]))
               for i, j in itertools.combinations(range(16), 2) for a in (y[i] - eps, y[i] + eps) for b in (y[j] - eps, y[j] + eps))
    got = loss(np.array([r["pred"] for r in sorted(out, key=lambda r: r["chrs"])]))
    assert best - 1e-12 <= got < best + 2e-3 and report["jobs"] <= 60


def test_medians_of_all_earlier_terms_are_those_of_each(spark):
    """One count of the values gives each term the medians of the rows before it: ties, NULLs, NaN, a column without values."""
    from gradeflow.operators.stats import earlier_medians, impute_values
    rng = np.random.default_rng(2)
    rows = [(int(t), None if rng.random() < 0.2 else float(rng.integers(0, 9)), float(rng.normal()) if rng.random() < 0.95 else float("nan"),
             None if t < 3 else 1.0, None) for t in rng.integers(0, 6, 400)]
    df = spark.createDataFrame(rows, "termnum long, a double, b double, late double, empty double").repartition(7)
    got = earlier_medians(df, ["a", "b", "late", "empty"], "termnum", [1, 2, 3, 4, 5])
    for t, medians in got.items():
        assert medians == impute_values(df.where(F.col("termnum") < t), ["a", "b", "late", "empty"])
    assert got[3]["late"] is None and got[4]["late"] == 1.0 and got[5]["empty"] is None


def test_importances_count_values_once_for_all_terms(spark, monkeypatch):
    """The medians don't cost a job per term, and the forests are those of medians taken term by term."""
    from gradeflow.operators import stats as S
    train, test = classes(spark, 200)
    df = train.unionByName(test).withColumn("termnum", (F.col("sid") % 4).cast("long")).withColumn("grdpts", F.col("label") * 3 + F.col("chrs"))
    df = df.withColumn("chrs", F.when(F.col("sid") % 5 > 0, F.col("chrs"))).coalesce(1)
    asked = []
    plain = S.exact_quantiles
    monkeypatch.setattr(S, "exact_quantiles", lambda *a, **k: (asked.append(a), plain(*a, **k))[1])
    got = {(r["termnum"], r["feature"]): r["importance"] for r in ML.forest_importance(df, num_trees=3).collect()}
    assert len(got) == 3 * len(ML.FEATURES) and len(asked) == 0
    written = ML.write_cut(df.select("termnum", "grdpts", *ML.FEATURES))
    for t in (1, 2, 3):
        early = written.where(F.col("termnum") < t)
        tr, _ = ML.prepare(early, early.limit(0), scale=False)
        m = ML.RandomForestRegressor(numTrees=3, seed=42, labelCol="grdpts").fit(tr)
        assert np.allclose([got[t, f] for f in ML.FEATURES], m.featureImportances.toArray())
