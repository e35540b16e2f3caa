"""Regression and classification models on Spark ML.

Every model is a ``method(train, test) -> test + pred`` so it plugs into
``rolling_eval``/``holdout_eval``.  Features are imputed (train median) and
z-scored with population std (train statistics) as column expressions, then
assembled; fitting and scoring are distributed Spark ML jobs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       OneVsRest, RandomForestClassifier, DecisionTreeClassifier)
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from gradeflow.functions.arrays import matrix
from gradeflow.functions.scalars import clip
from gradeflow.models import extra_trees, fm
from gradeflow.operators.knn import nearest
from gradeflow.operators.stats import apply_scale, earlier_medians, impute, impute_values, scale_params
from gradeflow.session import cut_lineage, scratch_path, write_cut

FEATURES = ["chrs", "lterm_gpa", "lterm_cum_gpa", "total_chrs", "term_chrs", "num_enrolled",
            "lterm_cgpa", "lterm_cum_cgpa", "total_enrolled"]


def prepare(train: DataFrame, test: DataFrame, features: Sequence[str] = FEATURES, scale: bool = True):
    """Impute (train median) and z-score (train mean / population std), assemble."""
    features = list(features)
    tr, te, _ = impute(train, features, "median", all_null="ignore", test=test)
    tr = tr.fillna(0.0, subset=features)
    te = te.fillna(0.0, subset=features)
    if scale:
        params = scale_params(tr, features)
        tr, te = apply_scale(tr, params, features), apply_scale(te, params, features)
    va = VectorAssembler(inputCols=features, outputCol="features")
    return va.transform(tr), va.transform(te)


def _regress(estimator, features=FEATURES, target="grdpts", scale=True):
    def method(train, test):
        tr, te = prepare(train, test, features, scale)
        model = estimator.copy().setLabelCol(target).setFeaturesCol("features") \
            .setPredictionCol("pred").fit(tr.withColumn(target, F.col(target).cast("double")))
        return model.transform(te).drop("features")
    return method


def linear(l2: float = 0.0, features: Sequence[str] = FEATURES, scale: bool = True):
    """OLS / ridge.  Spark's regParam is scaled: alpha / n * stddev_pop(label)
    reproduces ``SSE + alpha * ||w||^2`` with the normal-equation solver."""
    def method(train, test):
        tr, te = prepare(train, test, features, scale)
        reg = 0.0
        if l2:
            n, sd = tr.agg(F.count(F.lit(1)), F.stddev_pop("grdpts")).first()
            reg = l2 / n * (sd or 1.0)
        lr = LinearRegression(featuresCol="features", labelCol="grdpts", predictionCol="pred",
                              regParam=reg, elasticNetParam=0.0, standardization=False, solver="normal")
        return lr.fit(tr).transform(te).drop("features")
    return method


def sgd_linear(reg: float = 0.01, elastic_net: float = 1.0, loss: str = "squaredError"):
    """Linear model with L1 / L2 / elastic-net (squared loss) or L2 with Huber loss."""
    if loss == "huber":
        elastic_net = 0.0  # Spark: Huber allows L2 only
    return _regress(LinearRegression(regParam=reg, elasticNetParam=elastic_net, loss=loss, maxIter=100))


STEPS = (1.0, 0.5, 0.2, 0.05, 0.01)  # lengths tried along one direction, all in one pass


def eps_insensitive(eps: float = 0.1, c: float = 1.0, tol: float = 1e-6, max_jobs: int = 60, features=FEATURES, report: dict | None = None):
    """Linear epsilon-insensitive regression (linear SVR): mean of ``max(|y - wx - b| - eps, 0)`` plus ``|w|^2 / (2 c n)``.

    L-BFGS on a loss whose kink is rounded over a width that shrinks step by step; an iteration is ONE pass
    over the rows, which takes losses and gradients at several step lengths at once.  Starts from the median.
    Raises if the last width has not settled to ``tol`` of the objective in ``max_jobs`` passes."""
    features = list(features)

    def method(train, test):
        tr, te = prepare(train, test, features)
        x = cut_lineage(tr.select(F.col("grdpts").cast("double").alias("y"), vector_to_array("features").alias("x")).where("y IS NOT NULL"))
        n, spread = x.agg(F.count(F.lit(1)), F.stddev_pop("y")).first()
        if not n:
            raise ValueError("no row to learn from")
        if not math.isfinite(spread):
            raise FloatingPointError(f"epsilon-insensitive regression diverged: targets spread {spread}")
        jobs = 0

        def objective(points: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
            """Objective and gradient at each row (w, b) of ``points``."""
            nonlocal jobs
            jobs += 1
            k, size = points.shape

            def part(xs, y):
                out = np.zeros((k, size + 1))
                for j, p in enumerate(points):
                    r = y - xs @ p[:-1] - p[-1]
                    over = np.abs(r) - eps
                    slope = np.clip(over / width, 0, 1)
                    g = -np.sign(r) * slope
                    out[j] = [np.where(over >= width, over - width / 2, slope ** 2 * width / 2).sum(), *(xs.T @ g), g.sum()]
                return out.ravel()

            def run(batches):
                total = np.zeros(k * (size + 1))
                for b in batches:
                    if b.num_rows:
                        total += part(matrix(b.column("x")), b.column("y").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])
            got = np.zeros(k * (size + 1))
            for i, v in x.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
                got[i] = v
            got = got.reshape(k, size + 1) / n
            flat = np.hstack([points[:, :-1], np.zeros((k, 1))])
            return got[:, 0] + (flat ** 2).sum(1) / (2 * c * n), got[:, 1:] + flat / (c * n)

        at = np.array([0.0] * len(features) + [float(impute_values(x, ["y"], "median")["y"])])
        widths = [max(spread, 1e-6) * f for f in (0.3, 0.03, 0.003)]
        for width in widths:
            (now,), (grad,) = objective(at[None], width)
            past: list[tuple[np.ndarray, np.ndarray]] = []
            settled = False
            while jobs < max_jobs and not settled:
                d, marks = grad.copy(), []
                for s_, g_ in reversed(past):
                    marks.append(s_ @ d / (s_ @ g_))
                    d -= marks[-1] * g_
                if past:
                    d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
                for (s_, g_), m in zip(past, reversed(marks)):
                    d += (m - g_ @ d / (s_ @ g_)) * s_
                losses, grads = objective(at - np.outer(STEPS, d), width)
                if not np.isfinite(losses).any():
                    raise FloatingPointError(f"epsilon-insensitive regression diverged: objective {losses}")
                best = int(np.nanargmin(losses))
                gain = now - losses[best]
                if gain > 0:
                    step, turn = -STEPS[best] * d, grads[best] - grad
                    at, now, grad = at + step, losses[best], grads[best]
                    past = (past + [(step, turn)])[-8:] if step @ turn > 1e-14 else past
                elif past:
                    past = []  # steepest descent from here
                    continue
                settled = gain <= tol * now or now <= 0
        if not settled:
            raise RuntimeError(f"epsilon-insensitive regression did not settle in {max_jobs} passes")
        if report is not None:
            report.update(jobs=jobs, objective=float(now), at=at)
        wl = F.array(*[F.lit(float(v)) for v in at[:-1]])
        pred = F.aggregate(F.zip_with(vector_to_array("features"), wl, lambda a, c_: a * c_),
                           F.lit(0.0), lambda acc, v: acc + v) + F.lit(float(at[-1]))
        return te.withColumn("pred", pred).drop("features")
    return method


def tree(max_depth: int = 5):
    return _regress(DecisionTreeRegressor(maxDepth=max_depth), scale=False)


def forest(num_trees: int = 20, max_depth: int = 5, seed: int = 42):
    return _regress(RandomForestRegressor(numTrees=num_trees, maxDepth=max_depth, seed=seed), scale=False)


def gbt(max_iter: int = 20, max_depth: int = 3, seed: int = 42):
    return _regress(GBTRegressor(maxIter=max_iter, maxDepth=max_depth, seed=seed), scale=False)


def adaboost_r2(n_estimators: int = 5, max_depth: int = 3, seed: int = 42):
    """AdaBoost.R2 (linear loss): weighted trees, weights updated by one
    aggregate per round, weighted-median combination per test row."""
    def method(train, test):
        tr, te = prepare(train, test, scale=False)
        tr = tr.select("features", "grdpts").withColumn("_w", F.lit(1.0))  # written anew by every round
        models, alphas = [], []
        for m in range(n_estimators):
            dt = DecisionTreeRegressor(maxDepth=max_depth, weightCol="_w", labelCol="grdpts",
                                       featuresCol="features", predictionCol="_p", seed=seed + m)
            model = dt.fit(tr)
            p = model.transform(tr).withColumn("_e", F.abs(F.col("grdpts") - F.col("_p")))
            emax = p.agg(F.max("_e")).first()[0] or 0.0
            if emax == 0:
                models.append(model)
                alphas.append(1.0)
                break
            p = p.withColumn("_l", F.col("_e") / emax)
            lbar = p.agg(F.sum(F.col("_w") * F.col("_l")) / F.sum("_w")).first()[0]
            if lbar >= 0.5:
                if not models:
                    models.append(model)
                    alphas.append(1.0)
                break
            beta = lbar / (1 - lbar)
            models.append(model)
            alphas.append(math.log(1 / beta))
            if m + 1 < n_estimators:
                tr = write_cut(p.withColumn("_w", F.col("_w") * F.pow(F.lit(beta), 1 - F.col("_l")))
                                .drop("_p", "_e", "_l"), "boosted")
        out = te
        for i, model in enumerate(models):
            out = model.setPredictionCol(f"_p{i}").transform(out)
        pairs = F.array_sort(F.array(*[F.struct(F.col(f"_p{i}").alias("p"), F.lit(a).alias("a"))
                                       for i, a in enumerate(alphas)]))
        half = sum(alphas) / 2.0
        cum = F.transform(pairs, lambda s, i: F.struct(
            s["p"].alias("p"),
            F.aggregate(F.slice(pairs, 1, i + 1), F.lit(0.0), lambda acc, z: acc + z["a"]).alias("c")))
        med = F.filter(cum, lambda s: s["c"] >= half)[0]["p"]
        return out.withColumn("pred", med).drop("features", *[f"_p{i}" for i in range(len(models))])
    return method


# -- classifiers (label column: integer class) -------------------------------

def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``_w``: the smallest class count over the row's own.  The counts, one row a class, are broadcast: a shuffle by
    label would send all rows to as many tasks as there are classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    least = counts.agg(F.min("_c")).first()[0]
    return df.join(F.broadcast(counts.select(label, (F.lit(least) / F.col("_c")).alias("_w"))), label)


def without_summary(model, spark):
    """The model as saved and loaded: a training summary holds the session, which travels with the model to every task
    and can't once the session has observed a frame."""
    path = scratch_path(spark, "model")
    model.write().save(path)
    return type(model).load(path)


def classify(estimator, label: str = "label", weighted: bool = True, scale: bool = True, proba: bool = True):
    def method(train, test):
        tr, te = prepare(train, test, scale=scale)
        est = estimator.copy().setLabelCol(label).setFeaturesCol("features").setPredictionCol("prediction")
        if weighted:
            tr = balanced_weights(tr, label)
            if est.hasParam("weightCol"):
                est = est.setWeightCol("_w")
        model = est.fit(tr)
        out = (without_summary(model, tr.sparkSession) if getattr(model, "hasSummary", False) else model).transform(te)
        if proba and "probability" in out.columns:
            out = out.withColumn("p1", vector_to_array("probability")[1])
        return out.drop("features", "rawPrediction", "probability")
    return method


def one_class(train: DataFrame, label: str = "label") -> bool:
    """Whether a train side holds fewer than two classes."""
    least, most = train.agg(F.min(label), F.max(label)).first()
    return least == most


def several_classes(method, label: str = "label"):
    """A classifier that skips splits whose train side holds one class (or none): no test row of these
    is answered, as there is nothing to tell apart."""
    def checked(train, test):
        if one_class(train, label):
            return test.where(F.lit(False)).withColumn("prediction", F.lit(None).cast("double"))
        return method(train, test)
    return checked


def feature_vector(features: Sequence[str], missing: float = 0.0):
    """The features as an array; missing ones get a constant."""
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float(missing))) for f in features])


def neighbours(train: DataFrame, test: DataFrame, k: int, features: Sequence[str], target: str, key: str,
               report: dict | None = None) -> DataFrame:
    """(vec, y, distance, rank): the k nearest train rows of each distinct test vector, by (distance, ``key``).
    Equal test rows share their neighbours, so each vector is looked for once; of equal train rows no more than the
    k first by ``key`` can be among anyone's k nearest, so no more are searched."""
    base = train.where(F.col(target).isNotNull()).select(F.col(key).alias("bid"), feature_vector(features).alias("vec"),
                                                         F.col(target).cast("double").alias("y"))
    base = base.where(F.col("bid").isNotNull())
    first = F.row_number().over(W.partitionBy("vec").orderBy("bid"))  # the rank limit is pushed below the shuffle
    base = write_cut(base.withColumn("_first", first).where(F.col("_first") <= k).drop("_first"), "knn")
    queries = test.select(feature_vector(features).alias("vec")).distinct().select(F.col("vec").alias("qid"), "vec")
    return nearest(queries, base, k, report).withColumnRenamed("qid", "vec")


def _votes(weights: str):
    """A neighbour's weight: 1, or the inverse distance, where neighbours at no distance outweigh all others."""
    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights {weights!r}")
    if weights == "uniform":
        return F.lit(1.0)
    exact = F.min("distance").over(W.partitionBy("vec")) == 0  # k rows
    return F.when(exact, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance"))


def knn(k: int = 5, weights: str = "distance", features: Sequence[str] = FEATURES, target: str = "grdpts", key: str = "ord",
        report: dict | None = None):
    """k-nearest-neighbour regression: the (weighted) mean of the k nearest train rows' targets.

    Exact, see ``operators.knn``; ``key`` is unique in train and settles ties.  Features are taken as they are, missing
    ones as 0.  With fewer than k train rows all of them count; without any, ``pred`` is null."""
    def method(train, test):
        near = neighbours(train, test, k, features, target, key, report).withColumn("w", _votes(weights))
        pred = near.groupBy("vec").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("pred"))
        return test.withColumn("_vec", feature_vector(features)).join(
            pred.withColumnRenamed("vec", "_vec"), "_vec", "left").drop("_vec")
    return method


def knn_cls(k: int = 5, weights: str = "distance", features: Sequence[str] = FEATURES, label: str = "label", key: str = "ord",
            report: dict | None = None):
    """k-nearest-neighbour classification: the class with most (weighted) votes, ties to the smaller class; a
    train side with one class answers nothing."""
    def method(train, test):
        near = neighbours(train, test, k, features, label, key, report).withColumn("w", _votes(weights))
        votes = near.groupBy("vec", "y").agg(F.sum("w").alias("w"))
        best = votes.groupBy("vec").agg(F.min_by("y", F.struct(-F.col("w"), "y")).alias("prediction"))
        return test.withColumn("_vec", feature_vector(features)).join(
            best.withColumnRenamed("vec", "_vec"), "_vec", "left").drop("_vec")
    return several_classes(method, label)


def forest_cls(num_trees: int = 20, max_depth: int = 5, seed: int = 42):
    return classify(RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, seed=seed), scale=False)


def extra_trees_cls(num_trees: int = 20, max_depth: int = 5, seed: int = 42, features: Sequence[str] = FEATURES, label: str = "label"):
    """Extremely randomised trees (``models.extra_trees``) with balanced class weights: no bootstrap, thresholds drawn at
    random per node.  ``p1`` is the share of the second smallest label."""
    def method(train, test):
        tr, te = _imputed(train, test, features)
        tr = balanced_weights(tr.where(F.col(label).isNotNull()), label)
        labels = [r[0] for r in tr.select(label).distinct().orderBy(label).collect()]  # the classes
        number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)).cast("int") - 1
        x = F.array(*[F.col(f).cast("double") for f in features])
        rows = cut_lineage(tr.select(x.alias("x"), number.alias("c"), F.col("_w").cast("double").alias("w")))
        forest = extra_trees.grow(rows, len(features), len(labels), num_trees, max_depth, seed=seed)
        out = extra_trees.predict(te.withColumn("_x", x), forest, [float(v) for v in labels], "_x")
        return out.withColumn("p1", F.col("shares")[1]).drop("_x", "shares")
    return several_classes(method, label)


def ovr_forest(num_trees: int = 10, seed: int = 42):
    def method(train, test):
        tr, te = prepare(train, test, scale=False)
        ovr = OneVsRest(classifier=RandomForestClassifier(numTrees=num_trees, seed=seed),
                        labelCol="label", featuresCol="features", predictionCol="prediction")
        return without_summary(ovr.fit(tr), tr.sparkSession).transform(te).drop("features", "rawPrediction")
    return method


def gboost_cls(max_iter: int = 20, step: float = 0.1, seed: int = 42):
    return classify(GBTClassifier(maxIter=max_iter, stepSize=step, seed=seed), scale=False)


def _samme_fit(tr: DataFrame, n_estimators: int, max_depth: int, learning_rate: float, min_leaf: int, seed: int):
    """Trees and their say, from rows with ``features``, ``label`` (0/1) and weights ``_w``."""
    models, says = [], []
    tr = tr.select("features", "label", "_w")  # written anew by every round
    for m in range(n_estimators):
        dt = DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=min_leaf, weightCol="_w", labelCol="label",
                                    featuresCol="features", predictionCol="_p", seed=seed + m)
        model = dt.fit(tr)
        p = model.transform(tr).drop("rawPrediction", "probability")
        miss = (F.col("_p") != F.col("label")).cast("double")
        err = p.agg(F.sum(F.col("_w") * miss) / F.sum("_w")).first()[0]
        err = min(max(err, 1e-10), 1 - 1e-10)
        if err >= 0.5:
            break
        a = learning_rate * math.log((1 - err) / err)
        models.append(model)
        says.append(a)
        if m + 1 < n_estimators:
            tr = write_cut(p.withColumn("_w", F.col("_w") * F.exp(F.lit(a) * miss)).drop("_p"), "boosted")
    return models, says


def _samme_share(df: DataFrame, fitted, name: str) -> DataFrame:
    """``df`` with the share of the say that votes for class 1."""
    models, says = fitted
    if not models:
        return df.withColumn(name, F.lit(0.0))
    share = F.lit(0.0)
    for i, (model, a) in enumerate(zip(models, says)):
        df = model.setPredictionCol(f"_v{i}").transform(df).drop("rawPrediction", "probability")
        share = share + F.lit(a) * F.col(f"_v{i}")
    return df.withColumn(name, share / F.lit(sum(says))).drop(*[f"_v{i}" for i in range(len(models))])


def adaboost_samme(n_estimators: int = 5, max_depth: int = 2, seed: int = 42, learning_rate: float = 1.0, min_leaf: int = 1):
    """Binary SAMME on balanced weights: weighted stumps/trees, one aggregate per round; each tree's say is
    scaled by the learning rate.  ``p1`` is the share of the say that votes for class 1."""
    def method(train, test):
        tr, te = prepare(train, test, scale=False)
        fitted = _samme_fit(balanced_weights(tr, "label"), n_estimators, max_depth, learning_rate, min_leaf, seed)
        out = _samme_share(te, fitted, "p1")
        return out.withColumn("prediction", (F.col("p1") > 0.5).cast("double")).drop("features")
    return method


def svm_cls(reg: float = 0.01):
    return several_classes(classify(LinearSVC(regParam=reg, maxIter=50), proba=False))


def gmm_cls(k: int = 4, seed: int = 42):
    """Mixture components as classes: each component predicts its majority
    training label."""
    def method(train, test):
        tr, te = prepare(train, test)
        gm = GaussianMixture(k=k, seed=seed, featuresCol="features", predictionCol="_comp").fit(tr)
        comp = gm.transform(tr).groupBy("_comp", "label").agg(F.count(F.lit(1)).alias("_n"))
        # k x classes rows
        best = comp.withColumn("_r", F.row_number().over(W.partitionBy("_comp").orderBy(F.desc("_n"), "label"))) \
                   .where(F.col("_r") == 1).select("_comp", F.col("label").cast("double").alias("prediction"))
        out = gm.transform(te).join(F.broadcast(best), "_comp", "left")
        return out.drop("features", "_comp", "probability")
    return method


def stacked_cls(seed: int = 42, n_estimators: int = 8, learning_rate: float = 0.85, num_trees: int = 10, max_depth: int = 10):
    """SAMME stumps and a forest on z-scored features and balanced weights; their class-1 shares are stacked into a
    weighted logistic regression."""
    def method(train, test):
        tr, te = prepare(train, test)
        tr = balanced_weights(tr, "label")
        boosted = _samme_fit(tr, n_estimators, 1, learning_rate, 1, seed)
        rf = RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, seed=seed, weightCol="_w", probabilityCol="_prf",
                                    rawPredictionCol="_rrf", predictionCol="_yrf").fit(tr)
        rf = without_summary(rf, tr.sparkSession)
        va = VectorAssembler(inputCols=["_b0", "_b1"], outputCol="_meta")

        def meta(d):
            d = rf.transform(_samme_share(d, boosted, "_b0"))
            return va.transform(d.withColumn("_b1", vector_to_array("_prf")[1]))

        top = LogisticRegression(featuresCol="_meta", labelCol="label", weightCol="_w", predictionCol="prediction").fit(meta(tr))
        out = without_summary(top, tr.sparkSession).transform(meta(te))
        return out.select(*[c for c in te.columns if c != "features"], "prediction")
    return several_classes(method)


def _imputed(train: DataFrame, test: DataFrame, features: Sequence[str]):
    features = list(features)
    tr, te, _ = impute(train, features, "median", all_null="ignore", test=test)
    return tr.fillna(0.0, subset=features), te.fillna(0.0, subset=features)


def _scaled(train: DataFrame, test: DataFrame, features: Sequence[str]):
    """Imputed and z-scored columns, not assembled."""
    tr, te = _imputed(train, test, features)
    params = scale_params(tr, list(features))
    return apply_scale(tr, params, list(features)), apply_scale(te, params, list(features))


def fm_regress(dim: int = 8, ridge: float = 5.0, sweeps: int = 8, tol: float = 1e-3, seed: int = 42, bounds=(0.0, 4.0),
               features: Sequence[str] = FEATURES, report: dict | None = None):
    """Factorization machine over user, item and the real features, bounded like other predictors (``models.fm``)."""
    def method(train, test):
        tr, te = _scaled(train, test, features)
        model = fm.fit(tr, "grdpts", features, dim=dim, ridge=ridge, sweeps=sweeps, tol=tol, seed=seed, report=report)
        return fm.predict(te, model, features).withColumn("pred", clip(F.col("eta"), *bounds)).drop("eta")
    return method


def fm_classify(dim: int = 8, ridge: float = 5.0, sweeps: int = 8, tol: float = 1e-3, seed: int = 42,
                features: Sequence[str] = FEATURES, report: dict | None = None):
    """Two classes by the logistic loss: ``p1`` and ``prediction`` (1 from 0.5 on); a train side with one class answers nothing."""
    def method(train, test):
        tr, te = _scaled(train, test, features)
        model = fm.fit(tr, "label", features, dim=dim, ridge=ridge, sweeps=sweeps, tol=tol, seed=seed, logistic=True, report=report)
        out = fm.predict(te, model, features).withColumn("p1", 1 / (1 + F.exp(-F.col("eta")))).drop("eta")
        return out.withColumn("prediction", (F.col("p1") >= 0.5).cast("double"))
    return several_classes(method)


def forest_importance(df: DataFrame, features=FEATURES, term: str = "termnum", num_trees: int = 10,
                      seed: int = 42) -> DataFrame:
    """Impurity importances of a forest fitted on all terms before t, for each t.

    The input is written once for all fits; counts come from one aggregate, the medians of all of them from another.
    Rows without a term are left out."""
    df = write_cut(df.where(F.col(term).isNotNull()).select(term, "grdpts", *features), "importance")
    sizes = {r[0]: r[1] for r in df.groupBy(term).count().collect()}  # one row per term
    medians = earlier_medians(df, features, term, sorted(sizes)[1:])
    va = VectorAssembler(inputCols=list(features), outputCol="features")
    rows = []
    for t in sorted(sizes)[1:]:
        fill = {f: 0.0 if medians[t][f] is None else medians[t][f] for f in features}
        tr = va.transform(df.where(F.col(term) < t).fillna(fill).fillna(0.0, subset=list(features)))
        m = RandomForestRegressor(numTrees=num_trees, seed=seed, labelCol="grdpts").fit(tr)
        rows += [(int(t), f, float(v), int(sizes[t])) for f, v in zip(features, m.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, f"{term} long, feature string, importance double, test_count long")
