"""Train/test splitting and rolling evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.models import baselines as B
from gradeflow.operators import features as FT
from gradeflow.operators import split as SP
from gradeflow.operators.prep import union_all
from gradeflow.plans import rolling as RO
from gradeflow.plans.q_stats import with_cohort
from gradeflow.plans.registry import oracle, register, sql_view

T = 10
sql_view("v_rc", ["v_ratings", "v_students", "v_terms"], """
SELECT r.*, t.termnum AS cohort FROM v_ratings r
JOIN v_students s ON r.sid = s.id AND s.termbnr = s.cohort JOIN v_terms t ON s.cohort = t.termbnr""")


@register("split_cohort_term", oracle("""
SELECT sid, cid, termnum, cohort,
  CASE WHEN coalesce(cohort >= 0 AND cohort <= 1 AND termnum >= 0 AND termnum <= 4, false)
       THEN 'train' ELSE 'test' END AS split FROM v_rc""", "v_rc"))
def q_split_filter(fx):
    return SP.split_filter(with_cohort(fx), "0-1:0-4").select("sid", "cid", "termnum", "cohort", "split")


_MULTI = ["0-1", "2-3:4-8"]


@register("split_multi_filter", oracle("""
SELECT sid, cid, termnum, cohort,
  CASE WHEN coalesce(cohort BETWEEN 0 AND 1, false) OR coalesce(cohort BETWEEN 2 AND 3 AND termnum BETWEEN 4 AND 8, false)
         OR termnum <= 3 THEN 'train' ELSE 'test' END AS split FROM v_rc""", "v_rc"))
def q_split_multi(fx):
    return SP.split_data(with_cohort(fx), _MULTI).select("sid", "cid", "termnum", "cohort", "split")


@register("split_multi_filter_reference", oracle("""
SELECT sid, cid, termnum, cohort, 'train' AS split FROM v_rc
WHERE coalesce(cohort BETWEEN 0 AND 1, false) OR coalesce(cohort BETWEEN 2 AND 3 AND termnum BETWEEN 4 AND 8, false)
   OR (NOT (coalesce(cohort BETWEEN 0 AND 1, false) AND coalesce(cohort BETWEEN 2 AND 3 AND termnum BETWEEN 4 AND 8, false))
       AND termnum <= 3)
UNION ALL
SELECT sid, cid, termnum, cohort, 'test' FROM v_rc
WHERE NOT (coalesce(cohort BETWEEN 0 AND 1, false) AND coalesce(cohort BETWEEN 2 AND 3 AND termnum BETWEEN 4 AND 8, false))
  AND termnum > 3""", "v_rc"))
def q_split_multi_ref(fx):
    return SP.split_data(with_cohort(fx), _MULTI, mode="reference").select("sid", "cid", "termnum", "cohort", "split")


@register("split_next_term", oracle(f"""
SELECT sid, cid, termnum, CASE WHEN termnum < {T} THEN 'train' ELSE 'test' END AS split
FROM v_ratings WHERE termnum <= {T}""", "v_ratings"))
def q_next_term(fx):
    tr, te = SP.next_term_split(fx.ratings, T)
    return (tr.select("sid", "cid", "termnum", F.lit("train").alias("split"))
              .unionByName(te.select("sid", "cid", "termnum", F.lit("test").alias("split"))))


@register("split_all_terms", oracle(f"""
SELECT sid, cid, termnum, CASE WHEN termnum < {T} THEN 'train' ELSE 'test' END AS split FROM v_ratings""",
    "v_ratings"))
def q_all_terms(fx):
    return SP.all_term_split(fx.ratings, T).select("sid", "cid", "termnum", "split")


@register("split_window", oracle(f"""
SELECT sid, cid, termnum, CASE WHEN termnum < {T} THEN 'train' ELSE 'test' END AS split
FROM v_ratings WHERE termnum BETWEEN {T - 4} AND {T}""", "v_ratings"))
def q_window(fx):
    tr, te = SP.window_split(fx.ratings, T, 4)
    return (tr.select("sid", "cid", "termnum", F.lit("train").alias("split"))
              .unionByName(te.select("sid", "cid", "termnum", F.lit("test").alias("split"))))


@register("split_by_column", oracle("""
SELECT a.sid, a.cid, a.termnum, v.termnum AS at,
  CASE WHEN a.termnum <> v.termnum THEN 'train' ELSE 'test' END AS split
FROM v_ratings a, (SELECT DISTINCT termnum FROM v_ratings) v WHERE a.termnum BETWEEN v.termnum - 2 AND v.termnum
UNION ALL
SELECT sid, cid, termnum, -1, 'n_train ' || sum(n) OVER w FROM (
  SELECT NULL::BIGINT AS sid, NULL::VARCHAR AS cid, termnum, count(*) AS n FROM v_ratings GROUP BY termnum) t
WINDOW w AS (ORDER BY termnum RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
QUALIFY sum(n) OVER w IS NOT NULL""", "v_ratings"))
def q_split_by_col(fx):
    """Every split of the comparator splitter (train: earlier terms within a
    window of two), and the train sizes that the one-job summary reports."""
    parts = []
    for v, train, test in SP.splits(fx.ratings, "termnum", "lt", "eq", window=2):
        for side, d in (("train", train), ("test", test)):
            parts.append(d.select("sid", "cid", "termnum", F.lit(v).cast("long").alias("at"), F.lit(side).alias("split")))
    sizes = SP.split_summary(fx.ratings, "termnum").where("n_train > 0").select(
        F.lit(None).cast("long").alias("sid"), F.lit(None).cast("string").alias("cid"), "termnum",
        F.lit(-1).cast("long").alias("at"), F.concat(F.lit("n_train "), F.col("n_train").cast("string")).alias("split"))
    return union_all([*parts, sizes])


@register("split_random", oracle("""
SELECT sid, cid, termnum, CASE WHEN row_number() OVER (ORDER BY md5('7|' || sid || '|' || cid), sid, cid)
  <= floor((SELECT count(*) FROM v_ratings) * 0.8e0 + 1) THEN 'train' ELSE 'test' END AS split FROM v_ratings""",
    "v_ratings"))
def q_random(fx):
    return SP.random_split(fx.ratings, 0.8, seed=7, keys=["sid", "cid"]).select("sid", "cid", "termnum", "split")


@register("split_k_per_user", oracle("""
SELECT sid, cid, termnum, CASE WHEN row_number() OVER (PARTITION BY sid ORDER BY md5('7|' || sid || '|' || cid), cid) <= 3
  THEN 'test' ELSE 'train' END AS split FROM v_ratings""", "v_ratings"))
def q_holdout_k(fx):
    return SP.holdout_k(fx.ratings, 3, seed=7).select("sid", "cid", "termnum", "split")


sql_view("v_mi_te", ["v_ratings"], f"SELECT * FROM v_ratings WHERE termnum >= {T}")
sql_view("v_mi_moved", ["v_mi_te", "v_ratings"], f"""
SELECT sid, cid, termnum FROM (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY termnum, ord) AS r FROM v_mi_te
  WHERE cid NOT IN (SELECT cid FROM v_ratings WHERE termnum < {T})) x WHERE r <= 3""")


@register("split_min_instances", oracle(f"""
SELECT sid, cid, termnum, 'train' AS split FROM v_ratings WHERE termnum < {T}
UNION ALL SELECT sid, cid, termnum, 'train' FROM v_mi_moved
UNION ALL SELECT sid, cid, termnum, 'test' FROM v_mi_te t
  WHERE NOT EXISTS (SELECT 1 FROM v_mi_moved m WHERE m.sid = t.sid AND m.cid = t.cid AND m.termnum = t.termnum)""",
    "v_ratings", "v_mi_te", "v_mi_moved"))
def q_min_instances(fx):
    r = fx.ratings
    tr, te = SP.seed_unseen_items(r.where(F.col("termnum") < T), r.where(F.col("termnum") >= T), 3)
    return (tr.select("sid", "cid", "termnum", F.lit("train").alias("split"))
              .unionByName(te.select("sid", "cid", "termnum", F.lit("test").alias("split"))))


@register("split_xy", oracle("""
SELECT 'x' AS side, chrs, lterm_gpa, lterm_cum_gpa, total_chrs, NULL AS label FROM v_engineered
UNION ALL SELECT 'y', NULL, NULL, NULL, NULL, grdpts FROM v_engineered""", "v_engineered"))
def q_xy(fx):
    x, y = SP.xy(FT.engineer(fx.ratings), "grdpts", ["chrs", "lterm_gpa", "lterm_cum_gpa", "total_chrs"])
    return x.withColumn("side", F.lit("x")).unionByName(
        y.select(F.col("grdpts").alias("label"), F.lit("y").alias("side")), allowMissingColumns=True)


@register("rolling_eval", oracle("SELECT sid, cid, termnum, grdpts, pred, error FROM v_results", "v_results"))
def q_rolling(fx):
    res = RO.rolling_eval(fx.ratings, B.mean_of_means)
    return res.select("sid", "cid", "termnum", "grdpts", "pred", "error")


@register("split_eval_runner", oracle(
    "SELECT sid, cid, termnum, pred, error, CAST(termnum AS VARCHAR) AS split_key FROM v_results", "v_results"))
def q_runner(fx):
    res = RO.run_splits(SP.splits(fx.ratings, "termnum"), B.mean_of_means)
    return res.select("sid", "cid", "termnum", "pred", "error", "split_key")
