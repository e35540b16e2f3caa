"""Exploratory analyses described in the documentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.functions import scalars as SC
from gradeflow.operators import explore as EX
from gradeflow.operators import features as FT
from gradeflow.plans.registry import oracle, register


@register("bipartite_edges", oracle("""
SELECT e.id, e.instr_lname, e.instr_fname, e.weight, s.student_degree, i.instr_degree
FROM (SELECT id, instr_lname, instr_fname, count(*) AS weight FROM v_courses WHERE instr_lname IS NOT NULL
      GROUP BY id, instr_lname, instr_fname) e
JOIN (SELECT id, count(*) AS student_degree FROM (SELECT DISTINCT id, instr_lname, instr_fname FROM v_courses
      WHERE instr_lname IS NOT NULL) x GROUP BY id) s ON e.id = s.id
JOIN (SELECT instr_lname, instr_fname, count(*) AS instr_degree FROM (SELECT DISTINCT id, instr_lname, instr_fname
      FROM v_courses WHERE instr_lname IS NOT NULL) x GROUP BY instr_lname, instr_fname) i
  ON e.instr_lname = i.instr_lname AND e.instr_fname = i.instr_fname""", "v_courses"))
def q_bipartite(fx):
    return EX.bipartite_edges(fx.courses)


@register("major_flow", oracle("""
SELECT from_major, to_major, count(*) AS n FROM (
  SELECT pmajr AS to_major, lag(pmajr) OVER (PARTITION BY id ORDER BY termbnr) AS from_major FROM v_students) t
WHERE from_major IS NOT NULL AND from_major <> to_major GROUP BY from_major, to_major""", "v_students"))
def q_major_flow(fx):
    return EX.major_flow(fx.students)


@register("bottleneck_honeypot", oracle("""
SELECT cnum, n_fail, n_fail_switch, n_excel, n_excel_switch,
       n_fail_switch / nullif(n_fail, 0) AS bottleneck_rate, n_excel_switch / nullif(n_excel, 0) AS honeypot_rate
FROM (SELECT g.cnum,
        count_if(g.grdpts < 1.0e0) AS n_fail,
        count_if(g.grdpts < 1.0e0 AND s.nxt IS NOT NULL AND s.nxt <> s.pmajr) AS n_fail_switch,
        count_if(g.grdpts >= 3.67e0) AS n_excel,
        count_if(g.grdpts >= 3.67e0 AND s.nxt IS NOT NULL AND s.nxt <> s.pmajr) AS n_excel_switch
      FROM v_graded g JOIN (SELECT id, termbnr, pmajr, lead(pmajr) OVER (PARTITION BY id ORDER BY termbnr) AS nxt
                            FROM v_students) s ON g.id = s.id AND g.termbnr = s.termbnr
      WHERE g.grdpts IS NOT NULL GROUP BY g.cnum) a""", "v_graded", "v_students"))
def q_bottleneck(fx):
    graded = fx.courses.withColumn("grdpts", SC.grade_points("grade"))
    return EX.bottleneck_honeypot(graded, fx.students)


@register("correlations", oracle("""
SELECT corr(a.hsgpa, s.term_gpa) AS corr_hsgpa, corr(a.sat_total_1600, s.term_gpa) AS corr_sat, count(*) AS n
FROM v_st s JOIN v_admissions a ON s.sid = a.id""", "v_st", "v_admissions"))
def q_corr(fx):
    return EX.entry_correlations(FT.student_gpa(fx.ratings), fx.admissions)


@register("entity_term_stats", oracle("""
SELECT t.termnum, g.disc, count(DISTINCT g.id) AS n_students, count(DISTINCT g.cnum) AS n_courses,
       count(DISTINCT (g.instr_lname, g.instr_fname)) FILTER (WHERE g.instr_lname IS NOT NULL AND g.instr_fname IS NOT NULL)
         AS n_instructors,
       count(*) AS n_records, avg(g.grdpts) AS mean_grade,
       GROUPING(t.termnum) = 1 AS all_terms, GROUPING(g.disc) = 1 AS all_discs
FROM v_graded g JOIN v_terms t ON g.termbnr = t.termbnr GROUP BY ROLLUP (t.termnum, g.disc)""",
    "v_graded", "v_terms"))
def q_entity_stats(fx):
    g = fx.courses.withColumn("grdpts", SC.grade_points("grade")).join(F.broadcast(fx.term_map), "termbnr")
    return EX.entity_term_stats(g)


@register("sequence_patterns")
def q_seq(fx):
    p = EX.sequence_patterns(fx.ratings, min_support=0.2, max_len=2)
    return p.select(F.to_json("sequence").alias("sequence"), "freq")


@register("time_weighted_gpa", oracle("""
WITH t AS (SELECT sid, termnum, sum(chrs * grdpts) AS q, sum(chrs) AS h FROM v_ratings GROUP BY sid, termnum)
SELECT a.sid, a.termnum, sum(b.q * power(0.5e0, a.termnum - b.termnum)) / nullif(sum(b.h * power(0.5e0, a.termnum - b.termnum)), 0)
  AS tw_gpa
FROM t a LEFT JOIN t b ON a.sid = b.sid AND b.termnum < a.termnum GROUP BY a.sid, a.termnum""", "v_ratings"))
def q_tw_gpa(fx):
    return FT.decay_weighted_gpa(fx.ratings, 0.5)
