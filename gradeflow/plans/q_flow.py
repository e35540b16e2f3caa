"""Status labelling and college flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeflow.operators import flow as FL
from gradeflow.plans.registry import oracle, register, sql_view
from gradeflow.sources.fixtures import RECURSIVE


def _prev(x):
    return (f"CASE WHEN {x} % 100 = 10 THEN ({x} // 100 - 1) * 100 + 70 WHEN {x} % 100 = 40 "
            f"THEN ({x} // 100) * 100 + 10 ELSE ({x} // 100) * 100 + 40 END")


def _next(x):
    return (f"CASE WHEN {x} % 100 = 70 THEN ({x} // 100 + 1) * 100 + 10 WHEN {x} % 100 = 40 "
            f"THEN ({x} // 100) * 100 + 70 ELSE ({x} // 100) * 100 + 40 END")


sql_view("v_cal", ["v_students"], f"""
SELECT DISTINCT CAST(termbnr AS BIGINT) AS termbnr FROM v_students
UNION SELECT CAST({_prev('m')} AS BIGINT) FROM (SELECT min(termbnr) AS m FROM v_students) x""")
sql_view("v_grid", ["v_students", "v_cal"], """
SELECT i.id, c.termbnr, coalesce(s.pcoll, 'N') AS label
FROM (SELECT DISTINCT id FROM v_students) i CROSS JOIN v_cal c
LEFT JOIN v_students s ON s.id = i.id AND s.termbnr = c.termbnr""")
sql_view("v_grid_adm", ["v_grid", "v_admissions"], f"""
SELECT g.id, g.termbnr, CASE WHEN g.termbnr = a.cohort THEN a.application_college
  WHEN g.termbnr = {_prev('a.cohort')} THEN 'I' ELSE g.label END AS label
FROM v_grid g LEFT JOIN (SELECT id, arg_min(cohort, cohort) AS cohort, arg_min(application_college, cohort)
  AS application_college FROM v_admissions GROUP BY id) a ON g.id = a.id""")
sql_view("v_grid_grad", ["v_grid_adm", "v_degrees"], f"""
SELECT g.id, g.termbnr, CASE WHEN g.termbnr = t.gt THEN 'G' ELSE g.label END AS label
FROM v_grid_adm g LEFT JOIN (
  SELECT d.id, CASE WHEN x.label = 'N' THEN d.gradterm ELSE {_next('d.gradterm')} END AS gt
  FROM (SELECT id, min(gradterm) AS gradterm FROM v_degrees GROUP BY id) d
  LEFT JOIN v_grid_adm x ON x.id = d.id AND x.termbnr = d.gradterm) t ON g.id = t.id""")
sql_view("v_gk", ["v_grid_grad"], """
SELECT id, termbnr, label, row_number() OVER (PARTITION BY id ORDER BY termbnr) AS k FROM v_grid_grad""")


def _step(done, breaks, enrolled):
    L, t = "g.label", "g.termbnr"
    stop = f"(NOT {done} AND ({L} = 'G' OR {breaks} = 2))"
    active = f"(NOT {done} AND NOT {stop} AND {enrolled})"
    out = (f"CASE WHEN {done} THEN {L} WHEN {L} = 'G' THEN {L} WHEN {breaks} = 2 THEN 'D' "
           f"WHEN NOT {enrolled} THEN {L} WHEN {L} = 'N' THEN CASE WHEN {t} % 100 = 40 THEN 'NS' ELSE 'B' END "
           f"ELSE {L} END")
    nb = (f"CASE WHEN NOT {active} THEN {breaks} WHEN {L} = 'N' AND {t} % 100 <> 40 THEN {breaks} + 1 "
          f"WHEN {L} = 'N' THEN {breaks} ELSE 0 END")
    ne = f"({enrolled} OR (NOT {done} AND NOT {stop} AND {L} = 'I'))"
    nd = f"({done} OR {stop})"
    return f"g.id, g.k, g.termbnr, {out} AS label, {ne} AS enrolled, {nb} AS breaks, {nd} AS done"


sql_view("v_gaps", ["v_gk"], f"""
SELECT {_step('false', '0', 'false')} FROM v_gk g WHERE g.k = 1
UNION ALL
SELECT {_step('p.done', 'p.breaks', 'p.enrolled')} FROM v_gaps p JOIN v_gk g ON g.id = p.id AND g.k = p.k + 1""")
RECURSIVE.add("v_gaps")

sql_view("v_edges", ["v_gaps"], """
SELECT id, termbnr, src, dst FROM (
  SELECT id, termbnr, label AS src, lead(label) OVER (PARTITION BY id ORDER BY termbnr) AS dst FROM (
    SELECT * FROM (
      SELECT id, termbnr, label,
             min(CASE WHEN label = 'I' THEN termbnr END) OVER (PARTITION BY id) AS fi,
             min(CASE WHEN label IN ('G', 'D') AND termbnr >= fi0 THEN termbnr END) OVER (PARTITION BY id) AS st
      FROM (SELECT *, min(CASE WHEN label = 'I' THEN termbnr END) OVER (PARTITION BY id) AS fi0 FROM v_gaps) a) b
    WHERE fi IS NOT NULL AND termbnr >= fi AND (st IS NULL OR termbnr <= st)
      AND label NOT IN ('NS', 'B', 'N')) c) d
WHERE dst IS NOT NULL AND src <> dst""")


def _grid(fx):
    return FL.status_grid(fx.students)


def _labels(fx):
    g = FL.with_graduation(FL.with_admission(_grid(fx), fx.admissions), fx.degrees)
    return FL.label_gaps(g)


@register("status_grid", oracle("SELECT id, termbnr, label FROM v_grid", "v_grid"))
def q_grid(fx):
    return _grid(fx)


@register("status_admission", oracle("SELECT id, termbnr, label FROM v_grid_adm", "v_grid_adm"))
def q_adm(fx):
    return FL.with_admission(_grid(fx), fx.admissions)


@register("status_graduation", oracle("SELECT id, termbnr, label FROM v_grid_grad", "v_grid_grad"))
def q_grad(fx):
    return FL.with_graduation(FL.with_admission(_grid(fx), fx.admissions), fx.degrees)


@register("status_gaps", oracle("SELECT id, termbnr, label FROM v_gaps", "v_gaps"))
def q_gaps(fx):
    return _labels(fx)


@register("status_edges", oracle("SELECT id, termbnr, src, dst FROM v_edges", "v_edges"))
def q_edges(fx):
    return FL.edges(_labels(fx))


@register("flow_weights", oracle("""
SELECT e.src, e.dst, e.weight, i.inflow AS dst_inflow, o.outflow AS src_outflow FROM
  (SELECT src, dst, count(*) AS weight FROM v_edges GROUP BY src, dst) e
  JOIN (SELECT dst, sum(w) AS inflow FROM (SELECT dst, count(*) AS w FROM v_edges GROUP BY src, dst) x GROUP BY dst) i
    ON e.dst = i.dst
  JOIN (SELECT src, sum(w) AS outflow FROM (SELECT src, count(*) AS w FROM v_edges GROUP BY src, dst) x GROUP BY src) o
    ON e.src = o.src""", "v_edges"))
def q_flow(fx):
    w, nodes = FL.flow(FL.edges(_labels(fx)))
    i = nodes.select(F.col("node").alias("dst"), F.col("inflow").alias("dst_inflow"))
    o = nodes.select(F.col("node").alias("src"), F.col("outflow").alias("src_outflow"))
    return w.join(i, "dst").join(o, "src")


@register("flow_matrix", oracle("""
SELECT n.node AS src, n2.node AS dst, coalesce(e.w / (SELECT count(*) FROM v_edges), 0.0e0) AS share
FROM (SELECT DISTINCT src AS node FROM v_edges UNION SELECT DISTINCT dst FROM v_edges) n
CROSS JOIN (SELECT DISTINCT src AS node FROM v_edges UNION SELECT DISTINCT dst FROM v_edges) n2
LEFT JOIN (SELECT src, dst, count(*) AS w FROM v_edges GROUP BY src, dst) e ON e.src = n.node AND e.dst = n2.node""",
    "v_edges"))
def q_flow_matrix(fx):
    return FL.flow_grid(FL.edges(_labels(fx)))


#: The calendar of the test tables, the same at every scale.
WIDE_TERMS = [y * 100 + s for y in range(1995, 2002) for s in (10, 40, 70)]
sql_view("v_wide", ["v_gaps"], "SELECT id, " + ", ".join(
    f"max(CASE WHEN termbnr = {t} THEN label END) AS \"{t}\"" for t in WIDE_TERMS) + " FROM v_gaps GROUP BY id")


@register("status_wide", oracle("SELECT * FROM v_wide", "v_wide"))
def q_wide(fx):
    return FL.pivot_status(_labels(fx), WIDE_TERMS)
