"""Scalars, id maps, encodings, joins, dedup and set operations (2.2 - 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.functions import scalars as SC
from gradeflow.models import baselines as B
from gradeflow.operators import features as FT
from gradeflow.operators import ids as ID
from gradeflow.operators import prep as P
from gradeflow.operators import stats as S
from gradeflow.plans.registry import oracle, register, sql_view
from gradeflow.session import write_cut
from gradeflow.sources.fixtures import importance_frame
from gradeflow.spec import RATINGS_SPEC

GRADE_CASE = """CASE {g} WHEN 'A+' THEN 4.0e0 WHEN 'A' THEN 4.0e0 WHEN 'A-' THEN 3.67e0 WHEN 'B+' THEN 3.33e0
  WHEN 'B' THEN 3.0e0 WHEN 'B-' THEN 2.67e0 WHEN 'C+' THEN 2.33e0 WHEN 'C' THEN 2.0e0
  WHEN 'C-' THEN 1.67e0 WHEN 'D' THEN 1.0e0 WHEN 'F' THEN 0.0e0 WHEN 'IN' THEN 0.0e0 {extra}END"""
STD = GRADE_CASE.format(g="grade", extra="")
REPORT = GRADE_CASE.format(g="grade", extra="WHEN 'W' THEN 1.0e0 WHEN 'S' THEN 3.0e0 WHEN 'NC' THEN 1.0e0 ")
SPLIT_T = 10  # all-terms split used by the split-based examples: train termnum < 10

sql_view("v_graded", ["v_courses"], f"SELECT *, {STD} AS grdpts FROM v_courses")


def _graded(fx):
    return fx.courses.withColumn("grdpts", SC.grade_points("grade"))


def _engineered(fx):
    return FT.engineer(fx.ratings)


# -- 2.2 scalars ------------------------------------------------------------

@register("grade_to_points", oracle("SELECT id, termbnr, cnum, grade, ord, grdpts FROM v_graded", "v_graded"))
def q_grade_points(fx):
    return _graded(fx).select("id", "termbnr", "cnum", "grade", "ord", "grdpts")


@register("grade_policy_alt", oracle(f"""
SELECT id, termbnr, cnum, grade, ord, grdpts FROM (SELECT *, {REPORT} AS grdpts FROM v_courses) x
WHERE grdpts IS NOT NULL""", "v_courses"))
def q_grade_policy(fx):
    d = fx.courses.withColumn("grdpts", SC.grade_points("grade", policy="report"))
    return d.where(F.col("grdpts").isNotNull()).select("id", "termbnr", "cnum", "grade", "ord", "grdpts")


@register("grade_counts", oracle("SELECT grade, count(*) AS n FROM v_courses GROUP BY grade", "v_courses"))
def q_grade_counts(fx):
    return fx.courses.groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


_LEVEL = "CAST(nullif(regexp_extract(trim({c}), '[0-9]', 0), '') AS INTEGER)"


@register("course_level", oracle(f"""
SELECT DISTINCT cnum, disc, {_LEVEL.format(c='cnum')} AS clevel, {_LEVEL.format(c='disc')} AS disc_level
FROM v_courses""", "v_courses"))
def q_course_level(fx):
    return fx.courses.select("cnum", "disc", SC.course_level("cnum").alias("clevel"),
                             SC.course_level("disc").alias("disc_level")).distinct()


_NEXT = """CASE WHEN termbnr % 100 = 70 THEN (termbnr // 100 + 1) * 100 + 10
 WHEN termbnr % 100 = 40 THEN (termbnr // 100) * 100 + 70 ELSE (termbnr // 100) * 100 + 40 END"""
_PREV = """CASE WHEN termbnr % 100 = 10 THEN (termbnr // 100 - 1) * 100 + 70
 WHEN termbnr % 100 = 40 THEN (termbnr // 100) * 100 + 10 ELSE (termbnr // 100) * 100 + 40 END"""


@register("term_next", oracle(f"SELECT DISTINCT termbnr, {_NEXT} AS next_term FROM v_courses", "v_courses"))
def q_term_next(fx):
    return fx.courses.select("termbnr", SC.next_term("termbnr").alias("next_term")).distinct()


@register("term_prev", oracle(f"SELECT DISTINCT termbnr, {_PREV} AS prev_term FROM v_courses", "v_courses"))
def q_term_prev(fx):
    return fx.courses.select("termbnr", SC.prev_term("termbnr").alias("prev_term")).distinct()


sql_view("v_term_names", ["v_terms"], """
SELECT termnum, termbnr,
  CASE termbnr % 100 WHEN 10 THEN 'Spring' WHEN 40 THEN 'Summer' ELSE 'Fall' END || ' ' || CAST(termbnr // 100 AS VARCHAR) AS name,
  CASE termbnr % 100 WHEN 10 THEN 'Sp' WHEN 40 THEN 'Su' ELSE 'Fa' END || lpad(CAST((termbnr // 100) % 100 AS VARCHAR), 2, '0') AS short
FROM v_terms""")


def term_names(fx):
    t = fx.term_map
    return t.select("termnum", "termbnr", SC.term_display_name("termbnr").alias("name"),
                    SC.term_short_name("termbnr").alias("short"))


@register("term_name", oracle("""
SELECT r.termnum, n.name, n.short, count(*) AS n FROM v_ratings r LEFT JOIN v_term_names n ON r.termnum = n.termnum
GROUP BY r.termnum, n.name, n.short""", "v_ratings", "v_term_names"))
def q_term_name(fx):
    # the names table has one row per term: a broadcast with a calendar bound
    per_term = fx.ratings.groupBy("termnum").agg(F.count(F.lit(1)).alias("n"))
    return per_term.join(F.broadcast(term_names(fx).drop("termbnr")), "termnum", "left")


@register("rename_columns", oracle("""
SELECT id, cohort, permanent_address_zip AS zip, hsgpa, sat_total_1600 AS sat, hs_ceeb_code AS hs,
       application_college FROM v_admissions""", "v_admissions"))
def q_rename(fx):
    return fx.admissions.withColumnsRenamed({"permanent_address_zip": "zip", "sat_total_1600": "sat",
                                             "hs_ceeb_code": "hs"})


@register("drop_null_target", oracle(
    "SELECT id, termbnr, cnum, grade, grdpts, ord FROM v_graded WHERE grdpts IS NOT NULL", "v_graded"))
def q_drop_null_target(fx):
    return P.drop_missing(_graded(fx), "grdpts").select("id", "termbnr", "cnum", "grade", "grdpts", "ord")


@register("drop_null_rows", oracle(
    "SELECT * FROM v_admissions WHERE hsgpa IS NOT NULL AND sat_total_1600 IS NOT NULL", "v_admissions"))
def q_dropna(fx):
    return P.dropna(fx.admissions, ["hsgpa", "sat_total_1600"])


@register("clip_range", oracle("""
SELECT sid, cid, termnum, user_mean + item_mean - global_mean AS additive,
       CASE WHEN user_mean + item_mean - global_mean IS NULL THEN NULL
            ELSE least(greatest(user_mean + item_mean - global_mean, 0.0e0), 4.0e0) END AS clipped
FROM v_results""", "v_results"))
def q_clip(fx):
    d = FT.prior_means(fx.ratings).where(F.col("global_seen").isNotNull())
    add = F.col("user_mean") + F.col("item_mean") - F.col("global_mean")
    return d.select("sid", "cid", "termnum", add.alias("additive"), SC.clip(add, 0, 4).alias("clipped"))


@register("project_roles", oracle("""
SELECT sid, cid, chrs, lterm_gpa, lterm_cum_gpa, total_chrs, term_chrs, num_enrolled, lterm_cgpa,
       lterm_cum_cgpa, total_enrolled FROM v_engineered""", "v_engineered"))
def q_project_roles(fx):
    spec = RATINGS_SPEC
    return _engineered(fx).select(*spec.names("entities"), *spec.names("reals"))


@register("drop_feature", oracle("""
SELECT sid, cid, termnum, grdpts, chrs, lterm_gpa, lterm_cum_gpa, total_chrs, term_chrs, num_enrolled,
       lterm_cum_cgpa, total_enrolled FROM v_engineered""", "v_engineered"))
def q_drop_feature(fx):
    spec, d = RATINGS_SPEC.drop("lterm_cgpa", _engineered(fx))
    return d.select(*spec.all_names)


@register("abs_sq_error", oracle(
    "SELECT sid, cid, termnum, error, abs(error) AS abs_error, error * error AS sq_error FROM v_results",
    "v_results"))
def q_abs_sq(fx):
    return B.mean_of_means_all_terms(fx.ratings).select("sid", "cid", "termnum", "error", "abs_error", "sq_error")


_NULLABLE = ["lterm_gpa", "lterm_cum_gpa", "lterm_cgpa", "lterm_cum_cgpa"]


@register("is_all_null", oracle("""
SELECT termnum, col AS "column", n = 0 AS all_null FROM (
  SELECT termnum, count(lterm_gpa) AS lterm_gpa, count(lterm_cum_gpa) AS lterm_cum_gpa,
         count(lterm_cgpa) AS lterm_cgpa, count(lterm_cum_cgpa) AS lterm_cum_cgpa
  FROM v_engineered GROUP BY termnum) t
UNPIVOT (n FOR col IN (lterm_gpa, lterm_cum_gpa, lterm_cgpa, lterm_cum_cgpa))""", "v_engineered"))
def q_all_null(fx):
    return S.all_null_cols(_engineered(fx), _NULLABLE, by="termnum")


@register("season_filter", oracle(
    "SELECT id, termbnr FROM v_students WHERE termbnr % 100 <> 40", "v_students"))
def q_season(fx):
    return fx.students.where(~SC.is_summer("termbnr")).select("id", "termbnr")


# -- 2.3 ids and encodings ---------------------------------------------------

@register("idmap_sorted", oracle("""
SELECT row_number() OVER (ORDER BY instr_lname NULLS LAST, instr_fname NULLS LAST) - 1 AS idx,
       instr_lname, instr_fname
FROM (SELECT DISTINCT instr_lname, instr_fname FROM v_courses) d""", "v_courses"))
def q_idmap(fx):
    return ID.build_idmap(fx.courses, ["instr_lname", "instr_fname"])


sql_view("v_instr_map", ["v_courses"], """
SELECT row_number() OVER (ORDER BY instr_lname NULLS LAST, instr_fname NULLS LAST) - 1 AS idx,
       instr_lname, instr_fname
FROM (SELECT DISTINCT instr_lname, instr_fname FROM v_courses) d""")


@register("idmap_apply", oracle("""
SELECT c.id, c.termbnr, c.cnum, c.ord, m.idx AS iid FROM v_courses c LEFT JOIN v_instr_map m
ON c.instr_lname IS NOT DISTINCT FROM m.instr_lname AND c.instr_fname IS NOT DISTINCT FROM m.instr_fname""",
    "v_courses", "v_instr_map"))
def q_idmap_apply(fx):
    m = ID.build_idmap(fx.courses, ["instr_lname", "instr_fname"])
    d = ID.map_ids(fx.courses, m, ["instr_lname", "instr_fname"], "iid", remove=True)
    return d.select("id", "termbnr", "cnum", "ord", "iid")


@register("idmap_apply_renamed", oracle("""
SELECT s.id, s.termbnr, t.termnum AS cohort FROM v_students s LEFT JOIN v_terms t ON s.cohort = t.termbnr""",
    "v_students", "v_terms"))
def q_use_idmap(fx):
    m = fx.term_map.withColumnRenamed("termnum", "idx")
    return ID.use_idmap(fx.students, m, "cohort", "termbnr").select("id", "termbnr", "cohort")


sql_view("v_first_seen", ["v_ratings"], f"""
SELECT cid, row_number() OVER (ORDER BY side, ord) - 1 AS cid_index FROM (
  SELECT cid, side, ord, row_number() OVER (PARTITION BY cid ORDER BY side, ord) AS rn FROM (
    SELECT cid, CASE WHEN termnum < {SPLIT_T} THEN 0 ELSE 1 END AS side, ord FROM v_ratings) u) f
WHERE rn = 1""")


def _split(fx):
    r = fx.ratings
    return r.where(F.col("termnum") < SPLIT_T), r.where(F.col("termnum") >= SPLIT_T)


@register("index_first_seen", oracle(f"""
SELECT r.sid, f.cid_index AS cid, r.termnum, CASE WHEN r.termnum < {SPLIT_T} THEN 'train' ELSE 'test' END AS split
FROM v_ratings r JOIN v_first_seen f ON r.cid = f.cid""", "v_ratings", "v_first_seen"))
def q_index_first_seen(fx):
    tr, te, _ = ID.index_column(*_split(fx), "cid", ["ord"])
    return (tr.select("sid", "cid", "termnum", F.lit("train").alias("split"))
              .unionByName(te.select("sid", "cid", "termnum", F.lit("test").alias("split"))))


@register("unindex_column", oracle("SELECT sid, cid, termnum FROM v_ratings", "v_ratings"))
def q_unindex(fx):
    tr, te, m = ID.index_column(*_split(fx), "cid", ["ord"])
    return ID.unindex(tr.unionByName(te), m, "cid").select("sid", "cid", "termnum")


@register("encode_onehot", oracle("""
SELECT sid, cid, termnum, idx FROM v_ratings r JOIN (
  SELECT col, value, row_number() OVER (ORDER BY col, value) - 1 AS idx FROM (
    SELECT DISTINCT 0 AS col, substr(cid, 1, 1) AS value FROM v_ratings
    UNION ALL SELECT DISTINCT 1, CAST(termnum AS VARCHAR) FROM v_ratings) v) f
  ON f.col = 0 AND f.value = substr(r.cid, 1, 1) OR f.col = 1 AND f.value = CAST(r.termnum AS VARCHAR)""", "v_ratings"))
def q_onehot(fx):
    def with_major(d):
        return d.withColumn("major", F.substring("cid", 1, 1)).withColumn("term", F.col("termnum").cast("string"))
    tr, te = _split(fx)
    a, b, _ = ID.one_hot(with_major(tr), with_major(te), ["major", "term"])
    return a.unionByName(b).select("sid", "cid", "termnum", F.explode("onehot").alias("idx"))


sql_view("v_encoded", ["v_engineered"], f"""
WITH e AS (SELECT *, dense_rank() OVER (ORDER BY sid) - 1 AS sidx, dense_rank() OVER (ORDER BY cid) - 1 AS cidx
           FROM v_engineered),
     m AS (SELECT max(sidx) + 1 AS ns, max(cidx) + 1 AS nc FROM e)
SELECT sid, cid, termnum, CAST(sidx AS BIGINT) AS idx, 1.0e0 AS val FROM e
UNION ALL SELECT sid, cid, termnum, CAST(m.ns + cidx AS BIGINT), 1.0e0 FROM e, m
UNION ALL SELECT sid, cid, termnum, CAST(m.ns + m.nc AS BIGINT), chrs FROM e, m WHERE chrs IS NOT NULL
UNION ALL SELECT sid, cid, termnum, CAST(m.ns + m.nc + 1 AS BIGINT), lterm_gpa FROM e, m WHERE lterm_gpa IS NOT NULL""")


@register("encode_onehot_shared", oracle("SELECT * FROM v_encoded", "v_encoded"))
def q_onehot_shared(fx):
    e = write_cut(_engineered(fx).select("sid", "cid", "termnum", "chrs", "lterm_gpa"), "engineered")
    sm = ID.build_idmap(e, ["sid"], "sidx")
    cm = ID.build_idmap(e, ["cid"], "cidx")
    e = e.join(sm, "sid").join(cm, "cid")
    tr, te = e.where(F.col("termnum") < SPLIT_T), e.where(F.col("termnum") >= SPLIT_T)
    layout = ID.shared_offsets([tr, te], ["sidx", "cidx"])
    enc = ID.encode_entries(tr.unionByName(te), ["sidx", "cidx"], ["chrs", "lterm_gpa"], layout)
    x = enc.select("sid", "cid", "termnum", F.explode("entries").alias("e"))
    return x.select("sid", "cid", "termnum", F.col("e.idx").alias("idx"), F.col("e.val").alias("val"))


@register("encode_prev_items", oracle("""
SELECT u.sid, u.termnum, h.cid AS prev_item, h.grdpts AS prev_value
FROM (SELECT DISTINCT sid, termnum FROM v_ratings) u JOIN v_ratings h ON u.sid = h.sid AND h.termnum < u.termnum""",
    "v_ratings"))
def q_prev_items(fx):
    return ID.with_history(fx.ratings)


@register("encode_term_onehot", oracle(
    "SELECT sid, cid, termnum, CAST(termnum AS BIGINT) AS term_idx, 1.0e0 AS term_val FROM v_ratings", "v_ratings"))
def q_term_onehot(fx):
    return S.encode_term(fx.ratings, "onehot").select("sid", "cid", "termnum", "term_idx", "term_val")


@register("encode_term_real", oracle(
    "SELECT sid, cid, termnum, CAST(0 AS BIGINT) AS term_idx, CAST(termnum AS DOUBLE) AS term_val FROM v_ratings",
    "v_ratings"))
def q_term_real(fx):
    return S.encode_term(fx.ratings, "real").select("sid", "cid", "termnum", "term_idx", "term_val")


# -- 2.4 joins ------------------------------------------------------------

@register("join_sources", oracle("""
SELECT c.*, s.cohort, s.pmajr, s.term_earn_hrs, d.race, d.sex, d.entry_age,
       a.permanent_address_zip, a.hsgpa, a.sat_total_1600, a.hs_ceeb_code
FROM v_courses c LEFT JOIN v_students s ON c.id = s.id AND c.termbnr = s.termbnr
LEFT JOIN v_demographics d ON c.id = d.id
LEFT JOIN v_admissions a ON c.id = a.id AND s.cohort = a.cohort""",
    "v_courses", "v_students", "v_demographics", "v_admissions"))
def q_join_sources(fx):
    return P.assemble_sources(fx.courses, fx.students, fx.demographics, fx.admissions)


@register("join_group_feature", oracle("""
SELECT r.sid, r.cid, r.termnum, t.term_chrs FROM v_ratings r
LEFT JOIN (SELECT sid, termnum, sum(chrs) AS term_chrs FROM v_ratings GROUP BY 1, 2) t
ON r.sid = t.sid AND r.termnum = t.termnum""", "v_ratings"))
def q_attach(fx):
    r = fx.ratings
    agg = r.groupBy("sid", "termnum").agg(F.sum("chrs").alias("term_chrs"))
    return P.attach(r, agg, ["sid", "termnum"]).select("sid", "cid", "termnum", "term_chrs")


@register("join_pred_actual", oracle(
    "SELECT sid, cid, termnum, grdpts, pred FROM v_results", "v_results"))
def q_align(fx):
    res = B.mean_of_means_all_terms(fx.ratings)
    actual = res.select("sid", "cid", "termnum", "grdpts")
    return P.align(actual, res.select("sid", "cid", "pred")).select("sid", "cid", "termnum", "grdpts", "pred")


@register("semi_anti_cold_start", oracle(f"""
SELECT * FROM v_ratings t WHERE termnum >= {SPLIT_T}
AND sid IN (SELECT sid FROM v_ratings WHERE termnum < {SPLIT_T})
AND cid IN (SELECT cid FROM v_ratings WHERE termnum < {SPLIT_T})""", "v_ratings"))
def q_remove_cold(fx):
    tr, te = _split(fx)
    return P.remove_cold_start(tr, te)


sql_view("v_imp_first_last", ["v_importance"], """
SELECT * FROM v_importance WHERE model = 'count'
  AND termnum IN ((SELECT min(termnum) FROM v_importance), (SELECT max(termnum) FROM v_importance))""")


@register("align_outer_zero", oracle("""
SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.importance, 0.0e0) AS importance_first,
       coalesce(b.importance, 0.0e0) AS importance_last
FROM (SELECT feature, importance FROM v_importance WHERE model = 'count'
        AND termnum = (SELECT min(termnum) FROM v_importance)) a
FULL OUTER JOIN (SELECT feature, importance FROM v_importance WHERE model = 'count'
        AND termnum = (SELECT max(termnum) FROM v_importance)) b ON a.feature = b.feature""", "v_importance"))
def q_align_outer(fx):
    imp = importance_frame(fx).where(F.col("model") == "count")
    lo, hi = imp.agg(F.min("termnum"), F.max("termnum")).first()
    a = imp.where(F.col("termnum") == lo)
    b = imp.where(F.col("termnum") == hi)
    return P.align_importance(a, b, names=("first", "last"))


# -- 2.5 dedup, sets, sorts --------------------------------------------------

@register("latest_per_key", oracle("""
SELECT id, disc, cnum, termbnr, grade, ord FROM (
  SELECT *, row_number() OVER (PARTITION BY id, disc, cnum ORDER BY termbnr DESC, ord DESC) AS rn
  FROM v_graded WHERE grdpts IS NOT NULL) x WHERE rn = 1""", "v_graded"))
def q_latest(fx):
    d = P.drop_missing(_graded(fx), "grdpts")
    return P.latest_per_key(d, ["id", "disc", "cnum"], ["termbnr", "ord"], ["termbnr", "grade", "ord"])


@register("first_per_key", oracle("""
SELECT id, termbnr, disc, cnum, ord FROM (
  SELECT *, row_number() OVER (PARTITION BY id, termbnr ORDER BY ord) AS rn FROM v_courses) x WHERE rn = 1""",
    "v_courses"))
def q_first(fx):
    return P.first_per_key(fx.courses, ["id", "termbnr"], ["ord"], "row", ["disc", "cnum", "ord"])


@register("first_per_key_nonnull", oracle("""
SELECT id, arg_min(instr_lname, ord) FILTER (WHERE instr_lname IS NOT NULL) AS instr_lname,
       arg_min(instr_fname, ord) FILTER (WHERE instr_fname IS NOT NULL) AS instr_fname
FROM v_courses GROUP BY id""", "v_courses"))
def q_first_nonnull(fx):
    return P.first_per_key(fx.courses, ["id"], ["ord"], "nonnull", ["instr_lname", "instr_fname"])


@register("distinct_rows", oracle("SELECT DISTINCT id, termbnr FROM v_courses", "v_courses"))
def q_distinct(fx):
    return fx.courses.select("id", "termbnr").distinct()


@register("union_splits", oracle(f"""
SELECT sid, cid, termnum, CASE WHEN termnum < {SPLIT_T} THEN 'train' ELSE 'test' END AS split FROM v_ratings""",
    "v_ratings"))
def q_union(fx):
    tr, te = _split(fx)
    return P.union_all([tr.select("sid", "cid", "termnum", F.lit("train").alias("split")),
                        te.select("sid", "cid", "termnum", F.lit("test").alias("split"))])


@register("union_outer_columns", oracle("""
SELECT sid, cid, termnum, pred AS pred_mom, NULL::DOUBLE AS pred_global FROM v_results
UNION ALL
SELECT r.sid, r.cid, r.termnum, NULL::DOUBLE, g.global_mean FROM v_ratings r JOIN v_prior_global g
ON r.termnum = g.termnum WHERE g.global_seen IS NOT NULL""", "v_results", "v_ratings", "v_prior_global"))
def q_union_outer(fx):
    a = B.mean_of_means_all_terms(fx.ratings).select("sid", "cid", "termnum", F.col("pred").alias("pred_mom"))
    b = B.global_mean_all_terms(fx.ratings).select("sid", "cid", "termnum", F.col("pred").alias("pred_global"))
    return P.union_outer([a, b])


@register("except_ids", oracle(f"""
SELECT sid FROM v_ratings WHERE termnum >= {SPLIT_T} EXCEPT SELECT sid FROM v_ratings WHERE termnum < {SPLIT_T}""",
    "v_ratings"))
def q_except(fx):
    tr, te = _split(fx)
    return P.id_diff(te, tr, "sid")[0]


@register("intersect_ids", oracle(f"""
SELECT sid FROM v_ratings WHERE termnum >= {SPLIT_T} INTERSECT SELECT sid FROM v_ratings WHERE termnum < {SPLIT_T}""",
    "v_ratings"))
def q_intersect(fx):
    tr, te = _split(fx)
    return P.id_diff(te, tr, "sid")[1]


@register("sort_rows", oracle("SELECT sid, termnum, cid, grdpts FROM v_ratings ORDER BY sid, termnum, cid",
                              "v_ratings"))
def q_sort(fx):
    return fx.ratings.select("sid", "termnum", "cid", "grdpts").orderBy("sid", "termnum", "cid")


@register("rank_methods", oracle("""
SELECT method, rmse, n, CAST(rank() OVER (ORDER BY rmse, method) AS BIGINT) AS rank FROM (
  SELECT 'mean_of_means' AS method, sqrt(avg(error * error)) AS rmse, count(*) AS n FROM v_results
  UNION ALL
  SELECT 'global_mean', sqrt(avg(power(r.grdpts - least(greatest(g.global_mean, 0.0e0), 4.0e0), 2))), count(*)
  FROM v_ratings r JOIN v_prior_global g ON r.termnum = g.termnum WHERE g.global_seen IS NOT NULL) x""",
    "v_results", "v_ratings", "v_prior_global"))
def q_rank_methods(fx):
    res = {"mean_of_means": B.mean_of_means_all_terms(fx.ratings),
           "global_mean": B.global_mean_all_terms(fx.ratings)}
    return S.leaderboard(res)


@register("topk_features", oracle("""
SELECT i.termnum, i.feature, i.model, i.importance FROM v_importance i
JOIN (SELECT feature FROM v_importance WHERE termnum = (SELECT min(termnum) FROM v_importance)
      GROUP BY feature ORDER BY avg(importance) DESC, feature LIMIT 10) t ON i.feature = t.feature""",
    "v_importance"))
def q_topk(fx):
    return S.top_feature_series(importance_frame(fx), 10).select("termnum", "feature", "model", "importance")


@register("value_shares", oracle("""
SELECT cs, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM v_cs GROUP BY cs""", "v_cs"))
def q_shares(fx):
    return P.shares(FT.mark_cold_start(fx.ratings), "cs")
