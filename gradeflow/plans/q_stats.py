"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.functions import scalars as SC
from gradeflow.models import baselines as B
from gradeflow.operators import features as FT
from gradeflow.operators import stats as S
from gradeflow.plans.registry import oracle, register, sql_view
from gradeflow.session import write_cut
from gradeflow.sources.fixtures import importance_frame

SPLIT_T = 10
_FILL = ["lterm_gpa", "lterm_cum_gpa", "lterm_cgpa", "lterm_cum_cgpa"]


def _eng(fx, cols):
    """The columns of the engineered table, written once: statistics and the rows they apply to read that."""
    return write_cut(FT.engineer(fx.ratings).select("sid", "cid", "termnum", *cols), "engineered")


def _res(fx):
    return B.mean_of_means_all_terms(fx.ratings)


def _fill_sql(src: str, stat_src: str) -> str:
    cols = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM {stat_src})) AS {c}" for c in _FILL)
    return f"SELECT sid, cid, termnum, {cols} FROM {src}"


@register("impute_fill", oracle(_fill_sql("v_engineered", "v_engineered"), "v_engineered"))
def q_impute(fx):
    out, _ = S.impute(_eng(fx, _FILL), _FILL, "median")
    return out


sql_view("v_eng_train", ["v_engineered"], f"SELECT * FROM v_engineered WHERE termnum < {SPLIT_T}")


@register("impute_train_only", oracle(_fill_sql("v_engineered", "v_eng_train"), "v_engineered", "v_eng_train"))
def q_impute_train(fx):
    e = _eng(fx, _FILL)
    tr, te = e.where(F.col("termnum") < SPLIT_T), e.where(F.col("termnum") >= SPLIT_T)
    a, b, _ = S.impute(tr, _FILL, "median", test=te)
    return a.unionByName(b)


_Z = ["chrs", "lterm_gpa", "num_enrolled"]


def _z_sql(src: str, fit: str) -> str:
    parts = []
    for c in _Z:
        parts.append(f"({c} - (SELECT avg({c}) FROM {fit})) / (SELECT CASE WHEN coalesce(stddev_pop({c}), 0) = 0 "
                     f"THEN 1.0e0 ELSE stddev_pop({c}) END FROM {fit}) AS {c}")
    return f"SELECT sid, cid, termnum, {', '.join(parts)} FROM {src}"


@register("zscore", oracle(_z_sql("v_engineered", "v_engineered"), "v_engineered"))
def q_zscore(fx):
    e = _eng(fx, _Z)
    return S.scale(e, _Z)[0]


@register("zscore_train", oracle(_z_sql("v_engineered", "v_eng_train"), "v_engineered", "v_eng_train"))
def q_zscore_train(fx):
    e = _eng(fx, _Z)
    return S.scale(e, _Z, fit_on=e.where(F.col("termnum") < SPLIT_T))[0]


sql_view("v_eng_next", ["v_engineered"], f"SELECT * FROM v_engineered WHERE termnum <= {SPLIT_T}")


@register("zscore_joint", oracle(_z_sql("v_eng_next", "v_eng_next"), "v_eng_next"))
def q_zscore_joint(fx):
    e = _eng(fx, _Z)
    tr, te = e.where(F.col("termnum") < SPLIT_T), e.where(F.col("termnum") == SPLIT_T)
    params = S.scale_params(tr.unionByName(te), _Z)
    return S.apply_scale(tr, params, _Z).unionByName(S.apply_scale(te, params, _Z))


@register("unscale", oracle("SELECT sid, cid, termnum, chrs, lterm_gpa, num_enrolled FROM v_engineered",
                            "v_engineered"))
def q_unscale(fx):
    e = _eng(fx, _Z)
    z, params = S.scale(e, _Z)
    return S.unscale(z, params, _Z)


_MET = {
    "rmse": "sqrt(avg(error * error))",
    "mae": "avg(abs(error))",
    "mse": "avg(error * error)",
    "sse": "sum(error * error)",
}


def _metric_query(name):
    def q(fx):
        return S.metrics(_res(fx)).select(name, "n")
    q.__name__ = f"q_{name}"
    return q


for _m, _expr in _MET.items():
    register(_m, oracle(f"SELECT {_expr} AS {_m}, count(error) AS n FROM v_results", "v_results"))(_metric_query(_m))


@register("eval_matrix", oracle("""
SELECT v.termnum, s.sterm, sqrt(avg(error * error)) AS rmse, count(error) AS n,
       GROUPING(v.termnum) = 1 AS all_termnum, GROUPING(s.sterm) = 1 AS all_sterm
FROM v_results v JOIN v_st s ON v.sid = s.sid AND v.termnum = s.termnum
GROUP BY CUBE (v.termnum, s.sterm)""", "v_results", "v_st"))
def q_eval_matrix(fx):
    r = _res(fx).join(FT.student_term_no(fx.ratings), ["sid", "termnum"])
    return S.eval_grid(r, "termnum", "sterm")


@register("rating_weighted_rmse", oracle(
    "SELECT sqrt(sum(error * error * grdpts) / sum(grdpts)) AS rating_weighted_rmse FROM v_results", "v_results"))
def q_rating_rmse(fx):
    return S.rating_rmse(_res(fx))


@register("weighted_total", oracle("""
SELECT sqrt(sum(rmse * rmse * n) / sum(n)) AS total_rmse, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT termnum, sqrt(avg(error * error)) AS rmse, count(*) AS n FROM v_results GROUP BY termnum) t""",
    "v_results"))
def q_weighted_total(fx):
    per_term = _res(fx).groupBy("termnum").agg(F.sqrt(F.avg(F.col("error") ** 2)).alias("rmse"),
                                               F.count(F.lit(1)).alias("n"))
    return S.combine(per_term, "rmse", "n")


@register("cold_start_summary", oracle("""
SELECT termnum, count(*) AS n, count_if(cs <> 'ncs') AS cold, count_if(cs = 'ncs') AS not_cold,
       100.0e0 * count_if(cs <> 'ncs') / count(*) AS pct_cold, count_if(cs = 'csb') AS both,
       count_if(cs = 'css') AS student_only, count_if(cs = 'csc') AS course_only,
       GROUPING(termnum) = 1 AS is_all
FROM v_cs GROUP BY GROUPING SETS ((termnum), ())""", "v_cs"))
def q_cold_summary(fx):
    return S.cold_summary_by(FT.mark_cold_start(fx.ratings), "termnum")


sql_view("v_cls", ["v_results"], """
SELECT *, CAST(grdpts >= 1.67e0 AS INTEGER) AS label, CAST(pred >= 1.67e0 AS INTEGER) AS prediction
FROM v_results""")


def _cls(fx):
    r = _res(fx)
    return (r.withColumn("label", (F.col("grdpts") >= 1.67).cast("int"))
             .withColumn("prediction", (F.col("pred") >= 1.67).cast("int")))


@register("crosstab_margins", oracle("""
SELECT label, prediction, count(*) AS n, GROUPING(label) = 1 AS all_label, GROUPING(prediction) = 1 AS all_pred
FROM v_cls GROUP BY CUBE (label, prediction)""", "v_cls"))
def q_confusion(fx):
    return S.confusion(_cls(fx))


@register("classification_metrics", oracle("""
SELECT tp, fp, fn, tn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
       2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0))
         / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0) AS f1,
       (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS roc_auc
FROM (SELECT count_if(label = 1 AND prediction = 1) AS tp, count_if(label = 0 AND prediction = 1) AS fp,
             count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 0 AND prediction = 0) AS tn
      FROM v_cls) c""", "v_cls"))
def q_class_metrics(fx):
    return S.class_metrics(_cls(fx))


def _bin_sql(x):
    e = S.GRADE_BINS
    parts = []
    for i in range(len(e) - 1):
        op = "<=" if i == len(e) - 2 else "<"
        parts.append(f"WHEN {x} >= {e[i]}e0 AND {x} {op} {e[i + 1]}e0 THEN {i}")
    return "CASE " + " ".join(parts) + " END"


@register("prediction_histogram", oracle(f"""
SELECT termnum, kind, bin, count(*) AS n FROM (
  SELECT termnum, 'actual' AS kind, {_bin_sql('grdpts')} AS bin FROM v_results
  UNION ALL SELECT termnum, 'predicted', {_bin_sql('pred')} FROM v_results) u
WHERE bin IS NOT NULL GROUP BY termnum, kind, bin""", "v_results"))
def q_pred_hist(fx):
    return S.pred_hist(_res(fx))


@register("error_distribution", oracle("""
SELECT termnum, count(error) AS n, min(error) AS min, quantile_cont(error, 0.25) AS q25,
       quantile_cont(error, 0.5) AS q50, quantile_cont(error, 0.75) AS q75, max(error) AS max
FROM v_results GROUP BY termnum""", "v_results"))
def q_error_dist(fx):
    return S.error_quantiles(write_cut(_res(fx).select("termnum", "error"), "errors"), "termnum")


_DESC = ["hsgpa", "sat_total_1600"]


@register("describe_stats", oracle(" UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
       quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75,
       max({c}) AS max FROM v_admissions WHERE {c} >= 0""" for c in _DESC), "v_admissions"))
def q_describe(fx):
    return S.describe(fx.admissions, _DESC, lo=0.0)


# graduates: years to degree, cumulative GPA, terms, credits per term, summer credits
sql_view("v_grads", ["v_degrees", "v_students", "v_ratings"], """
SELECT d.id, s.cohort,
  ((d.gradterm // 100) * 2 + CASE WHEN d.gradterm % 100 = 70 THEN 1 ELSE 0 END
   - (s.cohort // 100) * 2 - CASE WHEN s.cohort % 100 = 70 THEN 1 ELSE 0 END + 1) / 2.0e0 AS years,
  g.cum_gpa, CAST(s.n_terms AS DOUBLE) AS n_terms, s.hrs / s.n_terms AS credits_per_term, s.summer_credits
FROM v_degrees d
JOIN (SELECT id, min(cohort) AS cohort, count(*) AS n_terms, sum(term_earn_hrs) AS hrs,
             sum(term_earn_hrs) FILTER (WHERE termbnr % 100 = 40) AS summer_credits
      FROM v_students GROUP BY id) s ON d.id = s.id
LEFT JOIN (SELECT sid, sum(chrs * grdpts) / sum(chrs) AS cum_gpa FROM v_ratings GROUP BY sid) g ON d.id = g.sid""")


@register("time_to_degree_stats", oracle("""
SELECT grp, metric, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75,
       max(value) AS max
FROM (SELECT id, grp, metric, value FROM (
        SELECT *, unnest(list_filter(['all', CASE WHEN years <= 4 THEN 'le4' ELSE 'gt4' END,
                                      CASE WHEN cum_gpa >= 3.5 THEN 'deans' END], lambda x: x IS NOT NULL)) AS grp
        FROM v_grads) g
      UNPIVOT INCLUDE NULLS (value FOR metric IN (years, cum_gpa, n_terms, credits_per_term, summer_credits))) u
GROUP BY grp, metric""", "v_grads"))
def q_grad_stats(fx):
    return S.grad_stats(fx.degrees, fx.students, fx.ratings)


@register("split_proportions", oracle("""
SELECT cohort, n, sum(n) OVER w / sum(n) OVER () AS train_share, 1 - sum(n) OVER w / sum(n) OVER () AS test_share
FROM (SELECT t.termnum AS cohort, count(*) AS n FROM v_ratings r JOIN v_students s ON r.sid = s.id
      JOIN v_terms t ON s.cohort = t.termbnr
      WHERE s.termbnr = s.cohort GROUP BY t.termnum) c
WINDOW w AS (ORDER BY cohort ROWS UNBOUNDED PRECEDING)""", "v_ratings", "v_students", "v_terms"))
def q_split_props(fx):
    return S.split_shares(with_cohort(fx), "cohort")


def with_cohort(fx):
    """Ratings with the student's cohort as a term ordinal."""
    coh = (fx.students.where(F.col("termbnr") == F.col("cohort")).select(F.col("id").alias("sid"), "cohort")
           .join(F.broadcast(fx.term_map.withColumnRenamed("termbnr", "cohort")), "cohort")
           .select("sid", F.col("termnum").alias("cohort")))
    return fx.ratings.join(coh, "sid")


@register("weighted_importance", oracle("""
SELECT feature, model, sum(importance * test_count) / sum(test_count) AS importance
FROM v_importance GROUP BY feature, model""", "v_importance"))
def q_weighted_imp(fx):
    return S.avg_importance(importance_frame(fx), ["feature", "model"])


@register("importance_series", oracle("""
SELECT termnum, feature, importance,
       first_value(importance) OVER (PARTITION BY feature ORDER BY termnum ROWS UNBOUNDED PRECEDING) AS first_importance
FROM (SELECT termnum, feature, avg(importance) AS importance FROM v_importance GROUP BY termnum, feature) t""",
    "v_importance"))
def q_imp_series(fx):
    return S.importance_ts(importance_frame(fx))
