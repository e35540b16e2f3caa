"""Window features, cold start, prior statistics and the mean baseline (2.6 + flagship)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.models import baselines as B
from gradeflow.operators import features as FT
from gradeflow.operators import stats as S
from gradeflow.plans.registry import oracle, register, sql_view

# ---------------------------------------------------------------------------
# DuckDB: student-term and course-term tables
# ---------------------------------------------------------------------------
sql_view("v_st", ["v_ratings"], """
SELECT sid, termnum, term_qpts, term_chrs, total_qpts, total_chrs,
       term_qpts / nullif(term_chrs, 0) AS term_gpa, total_qpts / nullif(total_chrs, 0) AS cum_gpa,
       lag(term_qpts / nullif(term_chrs, 0)) OVER o AS lterm_gpa,
       lag(term_chrs) OVER o AS lterm_chrs,
       lag(total_qpts / nullif(total_chrs, 0)) OVER o AS lterm_cum_gpa,
       lag(total_chrs) OVER o AS lterm_total_chrs,
       CAST(row_number() OVER o AS BIGINT) AS sterm
FROM (SELECT sid, termnum, term_qpts, term_chrs,
             sum(term_qpts) OVER (PARTITION BY sid ORDER BY termnum ROWS UNBOUNDED PRECEDING) AS total_qpts,
             sum(term_chrs) OVER (PARTITION BY sid ORDER BY termnum ROWS UNBOUNDED PRECEDING) AS total_chrs
      FROM (SELECT sid, termnum, sum(chrs * grdpts) AS term_qpts, sum(chrs) AS term_chrs
            FROM v_ratings GROUP BY sid, termnum) a) b
WINDOW o AS (PARTITION BY sid ORDER BY termnum)""")

sql_view("v_ct", ["v_ratings"], """
SELECT cid, termnum, num_enrolled, term_grdpts_sum, total_enrolled, total_grdpts_sum,
       term_grdpts_sum / nullif(num_enrolled, 0) AS term_cgpa,
       total_grdpts_sum / nullif(total_enrolled, 0) AS cum_cgpa,
       lag(term_grdpts_sum / nullif(num_enrolled, 0)) OVER o AS lterm_cgpa,
       lag(total_grdpts_sum / nullif(total_enrolled, 0)) OVER o AS lterm_cum_cgpa,
       lag(num_enrolled) OVER o AS lterm_num_enrolled,
       lag(total_enrolled) OVER o AS lterm_total_enrolled
FROM (SELECT cid, termnum, num_enrolled, term_grdpts_sum,
             CAST(sum(num_enrolled) OVER (PARTITION BY cid ORDER BY termnum ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_enrolled,
             sum(term_grdpts_sum) OVER (PARTITION BY cid ORDER BY termnum ROWS UNBOUNDED PRECEDING) AS total_grdpts_sum
      FROM (SELECT cid, termnum, count(cid) AS num_enrolled, sum(grdpts) AS term_grdpts_sum
            FROM v_ratings GROUP BY cid, termnum) a) b
WINDOW o AS (PARTITION BY cid ORDER BY termnum)""")

sql_view("v_engineered", ["v_ratings", "v_st", "v_ct"], """
SELECT r.sid, r.cid, r.termnum, r.grdpts, r.chrs, r.ord,
       s.lterm_gpa, s.lterm_cum_gpa, s.total_chrs, s.term_chrs, s.sterm,
       c.num_enrolled, c.lterm_cgpa, c.lterm_cum_cgpa, c.total_enrolled
FROM v_ratings r JOIN v_st s ON r.sid = s.sid AND r.termnum = s.termnum
JOIN v_ct c ON r.cid = c.cid AND r.termnum = c.termnum""")


def _r(fx):
    return fx.ratings


def _engineered(fx):
    d = FT.engineer(fx.ratings)
    return d.select("sid", "cid", "termnum", "grdpts", "chrs", "ord", "lterm_gpa", "lterm_cum_gpa",
                    "total_chrs", "term_chrs", F.col("sterm").cast("long").alias("sterm"),
                    "num_enrolled", "lterm_cgpa", "lterm_cum_cgpa", "total_enrolled")


# -- 2.6 -------------------------------------------------------------------

@register("quality_points", oracle("""
SELECT r.sid, r.cid, r.termnum, r.chrs * r.grdpts AS qpts, t.term_qpts
FROM v_ratings r JOIN (SELECT sid, termnum, sum(chrs * grdpts) AS term_qpts FROM v_ratings GROUP BY 1, 2) t
ON r.sid = t.sid AND r.termnum = t.termnum""", "v_ratings"))
def q_quality_points(fx):
    return FT.quality_points(_r(fx)).select("sid", "cid", "termnum", "qpts", "term_qpts")


@register("student_running_totals", oracle(
    "SELECT sid, termnum, term_qpts, term_chrs, total_qpts, total_chrs FROM v_st", "v_st"))
def q_student_totals(fx):
    return FT.student_totals(_r(fx))


@register("student_gpa", oracle("SELECT sid, termnum, term_gpa, cum_gpa FROM v_st", "v_st"))
def q_student_gpa(fx):
    return FT.student_gpa(_r(fx))


@register("student_lag_features", oracle(
    "SELECT sid, termnum, lterm_gpa, lterm_chrs, lterm_cum_gpa, lterm_total_chrs FROM v_st", "v_st"))
def q_student_lags(fx):
    return FT.student_lags(_r(fx))


@register("course_enrollment", oracle(
    "SELECT cid, termnum, num_enrolled, total_enrolled FROM v_ct", "v_ct"))
def q_course_enroll(fx):
    return FT.course_enroll(_r(fx))


@register("course_gpa", oracle("SELECT cid, termnum, term_cgpa, cum_cgpa FROM v_ct", "v_ct"))
def q_course_gpa(fx):
    return FT.course_gpa(_r(fx))


@register("course_lag_features", oracle(
    "SELECT cid, termnum, lterm_cgpa, lterm_cum_cgpa, lterm_num_enrolled, lterm_total_enrolled FROM v_ct",
    "v_ct"))
def q_course_lags(fx):
    return FT.course_lags(_r(fx))


@register("student_term_ordinal", oracle("SELECT sid, termnum, sterm FROM v_st", "v_st"))
def q_sterm(fx):
    return FT.student_term_no(_r(fx)).withColumn("sterm", F.col("sterm").cast("long"))


@register("engineer_features", oracle("SELECT * FROM v_engineered", "v_engineered"))
def q_engineer(fx):
    return _engineered(fx)


@register("cold_start_label", oracle(
    "SELECT sid, cid, termnum, grdpts, cs FROM v_cs", "v_cs"))
def q_cold_start(fx):
    return FT.mark_cold_start(_r(fx)).select("sid", "cid", "termnum", "grdpts", "cs")


@register("cold_start_flag_key", oracle("""
SELECT r.sid, r.cid, r.termnum, r.termnum = f.f AS cs_cid
FROM v_ratings r JOIN (SELECT cid, min(termnum) AS f FROM v_ratings GROUP BY cid) f ON r.cid = f.cid""",
    "v_ratings"))
def q_cold_flag(fx):
    return FT.mark_cold(_r(fx), "cid").select("sid", "cid", "termnum", "cs_cid")


@register("prior_stats", oracle("""
SELECT sid, cid, termnum, user_mean, item_mean, global_mean,
       user_seen IS NOT NULL AND item_seen IS NOT NULL AS warm
FROM v_results""", "v_results"))
def q_prior_stats(fx):
    d = FT.prior_means(_r(fx)).where(F.col("global_seen").isNotNull())
    return d.select("sid", "cid", "termnum", "user_mean", "item_mean", "global_mean",
                    (F.col("user_seen").isNotNull() & F.col("item_seen").isNotNull()).alias("warm"))


sql_view("v_prior_user_w4", ["v_ratings"], """
SELECT sid, termnum, sum(s) OVER w / nullif(sum(n) OVER w, 0) AS user_mean
FROM (SELECT sid, termnum, sum(grdpts) AS s, count(grdpts) AS n FROM v_ratings GROUP BY sid, termnum) t
WINDOW w AS (PARTITION BY sid ORDER BY termnum RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING)""")


@register("prior_stats_window", oracle("""
SELECT r.sid, r.cid, r.termnum, u.user_mean FROM v_ratings r
JOIN v_prior_user_w4 u ON r.sid = u.sid AND r.termnum = u.termnum""", "v_ratings", "v_prior_user_w4"))
def q_prior_window(fx):
    u = FT.prior_entity_stats(_r(fx), "sid", window=4, prefix="user")
    return _r(fx).join(u, ["sid", "termnum"]).select("sid", "cid", "termnum", "user_mean")


@register("running_rmse", oracle("""
SELECT termnum, n, sqrt(sse / n) AS rmse,
       sqrt(sum(sse) OVER w / sum(n) OVER w) AS running_rmse
FROM (SELECT termnum, sum(error * error) AS sse, count(error) AS n FROM v_results GROUP BY termnum) t
WINDOW w AS (ORDER BY termnum ROWS UNBOUNDED PRECEDING)""", "v_results"))
def q_running_rmse(fx):
    return FT.rmse_by_term(B.mean_of_means_all_terms(_r(fx)))


@register("balance_weights", oracle("""
SELECT r.sid, r.cid, r.termnum, r.alevel, m.mn / c.cnt AS weight
FROM (SELECT *, CAST(grdpts >= 3.67e0 AS INTEGER) AS alevel FROM v_ratings) r
JOIN (SELECT CAST(grdpts >= 3.67e0 AS INTEGER) AS alevel, count(*) AS cnt FROM v_ratings GROUP BY 1) c
  ON r.alevel = c.alevel
CROSS JOIN (SELECT min(cnt) AS mn FROM (SELECT count(*) AS cnt FROM v_ratings
            GROUP BY CAST(grdpts >= 3.67e0 AS INTEGER)) z) m""", "v_ratings"))
def q_balance(fx):
    d = _r(fx).withColumn("alevel", (F.col("grdpts") >= 3.67).cast("int"))
    return FT.balance_weights(d, "alevel").select("sid", "cid", "termnum", "alevel", "weight")


# -- flagship: next-term error of the mean baseline ------------------------

@register("pred_mean_of_means", oracle(
    "SELECT sid, cid, termnum, grdpts, pred, error FROM v_results", "v_results"))
def q_mom(fx):
    return B.mean_of_means_all_terms(_r(fx)).select("sid", "cid", "termnum", "grdpts", "pred", "error")


@register("pred_global_mean", oracle("""
SELECT r.sid, r.cid, r.termnum, r.grdpts, g.global_mean AS pred,
       r.grdpts - least(greatest(g.global_mean, 0.0e0), 4.0e0) AS error
FROM v_ratings r JOIN v_prior_global g ON r.termnum = g.termnum WHERE g.global_seen IS NOT NULL""",
    "v_ratings", "v_prior_global"))
def q_global_mean(fx):
    return B.global_mean_all_terms(_r(fx)).select("sid", "cid", "termnum", "grdpts", "pred", "error")


FLAGSHIP_SQL = """
SELECT CAST(termnum AS BIGINT) AS termnum, sqrt(avg(error * error)) AS rmse, avg(abs(error)) AS mae,
       stddev_pop(abs(error)) AS mae_std, count(error) AS counts, GROUPING(termnum) = 1 AS is_all
FROM v_results WHERE user_seen IS NOT NULL AND item_seen IS NOT NULL
GROUP BY GROUPING SETS ((termnum), ())"""


def flagship(fx):
    """Next-term error of the mean-of-means baseline by term, cold starts removed."""
    res = B.mean_of_means_all_terms(_r(fx), cold_start=False)
    return S.eval_by(res, "termnum").withColumn("termnum", F.col("termnum").cast("long"))


register("eval_by", oracle(FLAGSHIP_SQL, "v_results"))(flagship)


@register("eval_by_sample_std", oracle("""
SELECT cs, sqrt(avg(error * error)) AS rmse, avg(abs(error)) AS mae,
       stddev_samp(abs(error)) AS mae_std, count(error) AS counts, GROUPING(cs) = 1 AS is_all
FROM (SELECT v.*, c.cs FROM v_results v JOIN v_cs c ON v.sid = c.sid AND v.cid = c.cid AND v.termnum = c.termnum) x
GROUP BY GROUPING SETS ((cs), ())""", "v_results", "v_cs"))
def q_eval_samp(fx):
    res = B.mean_of_means_all_terms(FT.mark_cold_start(_r(fx)))
    return S.eval_by(res, "cs", ddof=1)
