"""Predictors, models and searches.

Model queries use the all-terms split (train: termnum < 10, test: the later
terms) over the engineered table; stochastic or iterative ones have no SQL
oracle (rows-only check) and are covered by tolerance tests.
"""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from gradeflow.models import baselines as B
from gradeflow.models import mf as MF
from gradeflow.models import ml as ML
from gradeflow.models.gram import linear_search
from gradeflow.operators import features as FT
from gradeflow.operators import ids as ID
from gradeflow.operators.knn import nearest
from gradeflow.plans import q_stats  # noqa: F401 - registers v_eng_train
from gradeflow.plans import rolling as RO
from gradeflow.plans.registry import oracle, register, sql_view

T = 10
OUT = ["sid", "cid", "termnum", "grdpts", "pred", "error"]


def _eng(fx):
    return FT.engineer(fx.ratings)


def _holdout(fx, method, cols=OUT):
    return RO.holdout_eval(_eng(fx), method, T).select(*cols)


def _cls_frame(fx, multi=False):
    e = _eng(fx)
    if multi:
        lab = (F.when(F.col("grdpts") >= 3.67, 3).when(F.col("grdpts") >= 2.67, 2)
                .when(F.col("grdpts") >= 1.67, 1).otherwise(0))
    else:
        lab = (F.col("grdpts") >= 3.67).cast("int")
    return e.withColumn("label", lab.cast("double"))


def _cls(fx, method, multi=False):
    # read again by every statistic, fit and scoring
    d = RO.written(_cls_frame(fx, multi).select("sid", "cid", "termnum", "label", *ML.FEATURES), "classes")
    tr, te = d.where(F.col("termnum") < T), d.where(F.col("termnum") >= T)
    return method(tr, te).select("sid", "cid", "termnum", "label", "prediction")


# -- baselines --------------------------------------------------------------

def _draw_sql(seed: int) -> str:
    return (f"CAST('0x' || substr(md5('{seed}|' || r.sid || '|' || r.cid || '|' || r.termnum), 1, 13) AS BIGINT) "
            "/ 4503599627370496.0e0")


# md5 draws of each row and the statistics of the terms before its own
sql_view("v_draws", ["v_ratings"], f"""
SELECT *, sqrt(-2.0e0 * ln(1.0e0 - u)) * cos(2 * pi() * v) AS z FROM (
  SELECT r.sid, r.cid, r.termnum, r.grdpts, tr.lo, tr.hi, tr.mu, tr.sd, tr.n, {_draw_sql(42)} AS u, {_draw_sql(43)} AS v
  FROM v_ratings r JOIN (
    SELECT t.termnum, min(grdpts) AS lo, max(grdpts) AS hi, avg(grdpts) AS mu,
      coalesce(stddev_samp(grdpts), 0) AS sd, count(grdpts) AS n
    FROM (SELECT DISTINCT termnum FROM v_ratings) t JOIN v_ratings e ON e.termnum < t.termnum GROUP BY t.termnum) tr
  ON r.termnum = tr.termnum) x""")


def _draws_sql(pred: str) -> str:
    return oracle(f"""
SELECT sid, cid, termnum, grdpts, pred, grdpts - least(greatest(pred, 0.0e0), 4.0e0) AS error
FROM (SELECT *, {pred} AS pred FROM v_draws) p""", "v_ratings", "v_draws")


@register("pred_uniform", _draws_sql("lo + (hi - lo) * u"))
def q_uniform(fx):
    return RO.rolling_eval(fx.ratings, B.uniform_baseline).select(*OUT)


@register("pred_normal", _draws_sql("mu + sd / sqrt(n) * z"))
def q_normal(fx):
    return RO.rolling_eval(fx.ratings, B.normal_baseline).select(*OUT)


@register("pred_gauss_clip", _draws_sql("least(greatest(2.0e0 + z, 0.0e0), 4.0e0)"))
def q_gauss(fx):
    return RO.rolling_eval(fx.ratings, lambda tr, te: B.gauss_baseline(te)).select(*OUT)


@register("fill_mean_of_means", oracle(f"""
SELECT t.sid, t.cid, t.termnum,
  ((SELECT avg(grdpts) FROM v_ratings WHERE termnum < {T}) + coalesce(u.m, 0.0e0) + coalesce(i.m, 0.0e0)) / 3.0e0 AS fill
FROM v_ratings t
LEFT JOIN (SELECT sid, avg(grdpts) AS m FROM v_ratings WHERE termnum < {T} GROUP BY sid) u ON t.sid = u.sid
LEFT JOIN (SELECT cid, avg(grdpts) AS m FROM v_ratings WHERE termnum < {T} GROUP BY cid) i ON t.cid = i.cid
WHERE t.termnum >= {T}""", "v_ratings"))
def q_fill(fx):
    r = fx.ratings
    pairs = r.where(F.col("termnum") >= T).select("sid", "cid", "termnum")
    return B.fill_cells(pairs, r.where(F.col("termnum") < T))


@register("matrix_approx", oracle(f"""
SELECT t.sid, t.cid, t.termnum,
  least(greatest(u.m + i.m - (SELECT avg(grdpts) FROM v_ratings WHERE termnum < {T}), 0.0e0), 4.0e0) AS approx
FROM v_ratings t
JOIN (SELECT sid, avg(grdpts) AS m FROM v_ratings WHERE termnum < {T} GROUP BY sid) u ON t.sid = u.sid
JOIN (SELECT cid, avg(grdpts) AS m FROM v_ratings WHERE termnum < {T} GROUP BY cid) i ON t.cid = i.cid
WHERE t.termnum >= {T}""", "v_ratings"))
def q_approx(fx):
    r = fx.ratings
    tr = r.where(F.col("termnum") < T)
    mu = tr.agg(F.avg("grdpts")).first()[0]
    # rank-2 additive factors: u = (user mean, 1), m = (1, item mean - mu)
    U = tr.groupBy("sid").agg(F.array(F.avg("grdpts"), F.lit(1.0)).alias("f"))
    M = tr.groupBy("cid").agg(F.array(F.lit(1.0), F.avg("grdpts") - F.lit(mu)).alias("f"))
    pairs = r.where(F.col("termnum") >= T).select("sid", "cid", "termnum")
    return MF.approx(pairs, U, M)


# -- matrix factorisation / SVD --------------------------------------------------

@register("mf_als")
def q_als(fx):
    return RO.holdout_eval(fx.ratings, MF.mf_als(rank=8), T).select(*OUT)


@register("mf_biased")
def q_biased(fx):
    return RO.holdout_eval(fx.ratings, MF.mf_biased(rank=8), T).select(*OUT)


@register("mf_batch_gd")
def q_gd(fx):
    return RO.holdout_eval(fx.ratings, MF.mf_gd(dim=5, reg=0.1), T).select(*OUT)


@register("pred_svd")
def q_svd(fx):
    return RO.holdout_eval(fx.ratings, MF.svd_baseline(5), T).select(*OUT)


@register("pred_svd_knn")
def q_svd_knn(fx):
    return RO.holdout_eval(fx.ratings, MF.svd_knn(5), T).select(*OUT)


@register("pred_svd_range")
def q_svd_range(fx):
    r = fx.ratings
    res = MF.svd_range(2, 6)(r.where(F.col("termnum") < T), r.where(F.col("termnum") >= T))
    return res.select("sid", "cid", "termnum", "k", "pred")


@register("join_reconstructed")
def q_lookup(fx):
    r = fx.ratings
    tr = r.where(F.col("termnum") < T)
    U, V, fill = MF.svd_factors(tr, 5)
    pairs = r.where(F.col("termnum") >= T).select("sid", "cid")
    cells = pairs.join(U.select("sid", "uf"), "sid").join(V.select("cid", "vf"), "cid") \
                 .select("sid", "cid", MF.dot("uf", "vf").alias("cell"))
    return pairs.join(cells, ["sid", "cid"], "left")


@register("fm_regress")
def q_fm(fx):
    return _holdout(fx, ML.fm_regress(dim=4, sweeps=2))


@register("fm_classify")
def q_fm_cls(fx):
    return _cls(fx, ML.fm_classify(dim=4, sweeps=100))  # ends by its tolerance; the bound is libFM's number of iterations


# -- regression ----------------------------------------------------------------

@register("reg_linear")
def q_lin(fx):
    return _holdout(fx, ML.linear())


@register("reg_linear_slope", oracle(f"""
SELECT sid, cid, termnum, grdpts, a + b * chrs AS pred FROM v_ratings,
  (SELECT regr_slope(grdpts, chrs) AS b, regr_intercept(grdpts, chrs) AS a FROM v_ratings WHERE termnum < {T}) m
WHERE termnum >= {T}""", "v_ratings"))
def q_lin_slope(fx):
    """The least-squares line on one feature, where SQL has the same."""
    res = RO.holdout_eval(fx.ratings, ML.linear(features=["chrs"], scale=False), T)
    return res.select("sid", "cid", "termnum", "grdpts", "pred")


@register("reg_ridge")
def q_ridge(fx):
    return _holdout(fx, ML.linear(l2=10.0))


@register("reg_sgd_l1")
def q_l1(fx):
    return _holdout(fx, ML.sgd_linear(reg=0.01, elastic_net=1.0))


@register("reg_eps_insensitive")
def q_eps(fx):
    return _holdout(fx, ML.eps_insensitive())


@register("reg_tree")
def q_tree(fx):
    return _holdout(fx, ML.tree(5))


@register("reg_forest")
def q_forest(fx):
    return _holdout(fx, ML.forest(10, 5))


@register("reg_adaboost")
def q_ada(fx):
    return _holdout(fx, ML.adaboost_r2(4, 3))


KNN = ["chrs", "total_chrs", "num_enrolled", "total_enrolled"]  # whole numbers: distances tie exactly in both engines


def _knn_sql() -> str:
    """The five nearest train rows of each distinct test vector, by (distance, ord)."""
    vec = ", ".join(f"coalesce({c}, 0.0e0) AS f{i}" for i, c in enumerate(KNN))
    d2 = " + ".join(f"(q.f{i} - b.f{i}) * (q.f{i} - b.f{i})" for i in range(len(KNN)))
    key = ", ".join(f"f{i}" for i in range(len(KNN)))
    on = " AND ".join(f"n.f{i} = t.f{i}" for i in range(len(KNN)))
    return f"""
WITH base AS (SELECT {vec}, grdpts AS y, ord FROM v_engineered WHERE termnum < {T}),
tests AS (SELECT sid, cid, termnum, grdpts, {vec} FROM v_engineered WHERE termnum >= {T}),
near AS (
  SELECT {', '.join(f'q.f{i}' for i in range(len(KNN)))}, min({{'d2': {d2}, 'ord': b.ord, 'y': b.y}}, 5) AS five
  FROM (SELECT DISTINCT {key} FROM tests) q, base b GROUP BY ALL),
rows_ AS (SELECT {key}, unnest(five) AS r FROM near),
weights AS (
  SELECT *, CASE WHEN min(r.d2) OVER (PARTITION BY {key}) = 0 THEN CASE WHEN r.d2 = 0 THEN 1.0e0 ELSE 0.0e0 END
    ELSE 1.0e0 / sqrt(r.d2) END AS w FROM rows_),
preds AS (SELECT {key}, avg(r.y) AS pred_uniform, sum(w * r.y) / sum(w) AS pred_distance FROM weights GROUP BY {key})
SELECT t.sid, t.cid, t.termnum, t.grdpts, n.pred_uniform, n.pred_distance FROM tests t JOIN preds n ON {on}"""


@register("reg_knn", oracle(_knn_sql(), "v_engineered"))
def q_knn(fx):
    """Both weightings of the five nearest train rows."""
    e = RO.written(_eng(fx), "knn")
    train, test = e.where(F.col("termnum") < T), e.where(F.col("termnum") >= T)
    near = ML.neighbours(train, test, 5, KNN, "grdpts", "ord").withColumn("w", ML._votes("distance"))
    preds = near.groupBy("vec").agg(F.avg("y").alias("pred_uniform"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("pred_distance"))
    return test.withColumn("vec", ML.feature_vector(KNN)).join(preds, "vec").select(
        "sid", "cid", "termnum", "grdpts", "pred_uniform", "pred_distance")


@register("cls_knn", """
WITH e AS (SELECT vec_id, label, embedding, vec_id % 5 = 0 AS test FROM embeddings),
near AS (
  SELECT q.vec_id, any_value(q.label) AS label, min({'d2': list_sum(list_transform(list_zip(q.embedding, b.embedding),
    lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))),
    'vec_id': b.vec_id, 'y': b.label}, 7) AS seven
  FROM e q, e b WHERE q.test AND NOT b.test GROUP BY q.vec_id),
rows_ AS (SELECT vec_id, label, unnest(seven) AS r FROM near),
weights AS (
  SELECT *, CASE WHEN min(r.d2) OVER (PARTITION BY vec_id) = 0 THEN CASE WHEN r.d2 = 0 THEN 1.0e0 ELSE 0.0e0 END
    ELSE 1.0e0 / sqrt(r.d2) END AS w FROM rows_),
votes AS (SELECT vec_id, label, r.y AS y, sum(w) AS w FROM weights GROUP BY ALL)
SELECT vec_id, CAST(label AS DOUBLE) AS label, CAST(y AS DOUBLE) AS prediction FROM votes
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, y) = 1""")
def q_cls_knn(fx):
    """Labels of every fifth embedding by distance-weighted vote of its seven nearest others."""
    e = fx.table("embeddings").select("vec_id", F.col("label").cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    base, queries = e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0")
    near = nearest(queries.select(F.col("vec_id").alias("qid"), "vec"), base.select(F.col("vec_id").alias("bid"), F.col("label").alias("y"), "vec"), 7)
    votes = near.withColumnRenamed("qid", "vec").withColumn("w", ML._votes("distance")).groupBy("vec", "y").agg(F.sum("w").alias("w"))
    best = votes.groupBy(F.col("vec").alias("vec_id")).agg(F.min_by("y", F.struct(-F.col("w"), "y")).alias("prediction"))
    return queries.select("vec_id", "label").join(best, "vec_id")


# -- classification ----------------------------------------------------------------

@register("cls_forest")
def q_cls_forest(fx):
    return _cls(fx, ML.forest_cls(10, 5))


@register("cls_extra_trees")
def q_cls_extra(fx):
    return _cls(fx, ML.extra_trees_cls(10, 5))


@register("cls_one_vs_rest")
def q_ovr(fx):
    return _cls(fx, ML.ovr_forest(5), multi=True)


@register("cls_adaboost")
def q_samme(fx):
    return _cls(fx, ML.adaboost_samme(4, 2))


@register("cls_gboost")
def q_gbc(fx):
    return _cls(fx, ML.gboost_cls(10))


@register("cls_svm_linear")
def q_svc(fx):
    return _cls(fx, ML.svm_cls())


@register("cls_gmm")
def q_gmm(fx):
    return _cls(fx, ML.gmm_cls(4))


@register("cls_stacked")
def q_stack(fx):
    return _cls(fx, ML.stacked_cls())


@register("forest_importance")
def q_importance(fx):
    return ML.forest_importance(_eng(fx), num_trees=5)


# -- preprocessing / searches needing a model ------------------------------------------

def _assembled_sql() -> str:
    """Cold starts out of the test side, medians and z-scores of the train side."""
    fill = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM v_eng_train)) AS {c}" for c in ML.FEATURES)
    z = ", ".join(f"(f.{c} - m.{c}_m) / CASE WHEN m.{c}_s = 0 THEN 1.0e0 ELSE m.{c}_s END AS {c}" for c in ML.FEATURES)
    stats = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in ML.FEATURES)
    pos = ", ".join(f"{{'pos': {i}, 'value': {c}}}" for i, c in enumerate(ML.FEATURES))
    return f"""
SELECT sid, cid, termnum, split, e.pos AS pos, e.value AS value FROM (
  SELECT sid, cid, termnum, split, unnest([{pos}]) AS e FROM (
    SELECT f.sid, f.cid, f.termnum, f.split, {z} FROM
      (SELECT sid, cid, termnum, CASE WHEN termnum < {T} THEN 'train' ELSE 'test' END AS split, {fill} FROM v_engineered
       WHERE termnum < {T} OR (sid IN (SELECT sid FROM v_eng_train) AND cid IN (SELECT cid FROM v_eng_train))) f,
      (SELECT {stats} FROM (SELECT {fill} FROM v_eng_train) t) m) z) u"""


@register("assemble_features", oracle(_assembled_sql(), "v_engineered", "v_eng_train"))
def q_assemble(fx):
    """cold-start removal -> index and back -> impute -> scale -> assemble, on the all-terms split."""
    from pyspark.ml.functions import vector_to_array

    from gradeflow.operators.prep import remove_cold_start
    e = RO.written(_eng(fx).select("sid", "cid", "termnum", "ord", *ML.FEATURES), "assemble")
    tr, te = e.where(F.col("termnum") < T), e.where(F.col("termnum") >= T)
    te = remove_cold_start(tr, te)
    tr, te, m = ID.index_column(tr, te, "cid", ["ord"])
    a, b = ML.prepare(tr, te)
    out = ID.unindex(a.withColumn("split", F.lit("train")).unionByName(b.withColumn("split", F.lit("test"))), m, "cid")
    return out.select("sid", "cid", "termnum", "split", F.posexplode(vector_to_array("features")).alias("pos", "value"))


SEARCH = ["chrs", "term_chrs", "num_enrolled"]


def _line_sql(pairs, l2s, windows) -> str:
    """Rolling RMSE of two-feature least squares by its closed form, for each pair, ridge penalty and window."""
    parts = []
    for (a, b), l2, w in itertools.product(pairs, l2s, windows):
        near = "" if w is None else f" AND r.termnum >= t.termnum - {w}"
        parts.append(f"""
SELECT '{a},{b}' AS features, CAST({l2!r} AS DOUBLE) AS l2, CAST({'NULL' if w is None else w} AS BIGINT) AS window,
  sqrt(avg(e * e)) AS rmse, count(*) AS n FROM (
  SELECT v.grdpts - least(greatest(my + b1 * (v.{a} - m1) + b2 * (v.{b} - m2), 0.0e0), 4.0e0) AS e
  FROM v_engineered v JOIN (
    SELECT termnum, my, m1, m2, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
      (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM (
      SELECT t.termnum, avg(grdpts) AS my, avg({a}) AS m1, avg({b}) AS m2,
        count(*) * var_pop({a}) + {l2!r} AS s11, count(*) * var_pop({b}) + {l2!r} AS s22, count(*) * covar_pop({a}, {b}) AS s12,
        count(*) * covar_pop({a}, grdpts) AS s1y, count(*) * covar_pop({b}, grdpts) AS s2y
      FROM (SELECT DISTINCT termnum FROM v_engineered) t JOIN v_engineered r ON r.termnum < t.termnum{near}
      GROUP BY t.termnum) s) m ON m.termnum = v.termnum) x""")
    return " UNION ALL ".join(parts)


PAIRS = list(itertools.combinations(SEARCH, 2))


def _search_frame(fx):
    return RO.written(_eng(fx).select("termnum", "grdpts", *SEARCH), "search")


@register("feature_combinations", oracle(f"SELECT features, rmse, n FROM ({_line_sql(PAIRS, [0.0], [None])}) s", "v_engineered"))
def q_feature_search(fx):
    """Rolling RMSE of least squares on every pair of features, all from one scan and one pass of errors."""
    return linear_search(_search_frame(fx), SEARCH, PAIRS).select("features", "rmse", "n")


@register("grid_search", oracle(f"""SELECT l2, "window", rmse, n FROM ({_line_sql(PAIRS[:1], [0.0, 100.0, 10000.0], [None, 4])}) s""",
                                "v_engineered"))
def q_grid(fx):
    """Rolling RMSE over a grid of ridge penalties and train windows."""
    return linear_search(_search_frame(fx), SEARCH[:2], l2s=[0.0, 100.0, 10000.0], windows=[None, 4]).select("l2", "window", "rmse", "n")
