"""Sequential status labelling and the college transition graph.

Labels: a college code while attending, 'N' absent, 'I' the term before the
admission cohort, 'G' graduated, 'NS' summer gap, 'B' break, 'D' dropped out.
Each student's sequence has at most #terms entries, so per-student arrays
are bounded by the term calendar, never by the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from gradeflow.functions.scalars import SUMMER, next_term, prev_term
from gradeflow.operators.prep import first_per_key
from gradeflow.operators.split import distinct_values

# Status codes.
ABSENT, INTENT, GRAD, DROP, NO_SUMMER, BREAK = "N", "I", "G", "D", "NS", "B"


def term_calendar(students: DataFrame, term: str = "termbnr") -> list[int]:
    """Distinct term codes plus the term before the first (for the 'I' label)."""
    terms = [int(t) for t in distinct_values(students, term)]
    first = terms[0]
    year, season = divmod(first, 100)
    before = (year - 1) * 100 + 70 if season == 10 else year * 100 + (10 if season == 40 else 40)
    return [before] + terms


def status_grid(students: DataFrame, terms: Sequence[int] | None = None, sid: str = "id",
                term: str = "termbnr", college: str = "pcoll", order: str | None = None) -> DataFrame:
    """(id, termbnr, label) for every student x calendar term: the college of the
    first record in that term, else 'N'.  The calendar is a short literal list,
    so the expansion is an ``explode`` per student, not a join."""
    terms = list(terms or term_calendar(students, term))
    ids = students.select(sid).distinct()
    grid = ids.select(sid, F.explode(F.array(*[F.lit(int(t)).cast("long") for t in terms])).alias(term))
    rec = students.select(sid, F.col(term).cast("long").alias(term), college, *([order] if order else []))
    first = first_per_key(rec, [sid, term], [order] if order else [college], "row", [college])
    return (grid.join(first, [sid, term], "left")
                .select(sid, term, F.coalesce(F.col(college), F.lit(ABSENT)).alias("label")))


def with_admission(grid: DataFrame, admissions: DataFrame, sid: str = "id", term: str = "termbnr",
                   cohort: str = "cohort", college: str = "application_college") -> DataFrame:
    """At the cohort term set the applied college; the previous term becomes 'I'."""
    a = first_per_key(admissions.select(sid, cohort, college), [sid], [cohort], "row", [cohort, college])
    a = a.select(sid, F.col(cohort).cast("long").alias("_coh"), F.col(college).alias("_app"))
    j = grid.join(a, sid, "left")
    lab = (F.when(F.col(term) == F.col("_coh"), F.col("_app"))
            .when(F.col(term) == prev_term("_coh"), F.lit(INTENT))
            .otherwise(F.col("label")))
    return j.withColumn("label", lab).drop("_coh", "_app")


def with_graduation(grid: DataFrame, degrees: DataFrame, sid: str = "id", term: str = "termbnr",
                    gradterm: str = "gradterm") -> DataFrame:
    """'G' at the graduation term when absent then, otherwise at the next term."""
    d = first_per_key(degrees.select(sid, gradterm), [sid], [gradterm], "row", [gradterm])
    d = d.select(sid, F.col(gradterm).cast("long").alias("_g"))
    at = grid.join(d, sid).where(F.col(term) == F.col("_g")).select(sid, F.col("label").alias("_gl"))
    target = d.join(at, sid, "left").select(
        sid, F.when(F.col("_gl") == ABSENT, F.col("_g")).otherwise(next_term("_g")).alias("_gt"))
    j = grid.join(target, sid, "left")
    return j.withColumn("label", F.when(F.col(term) == F.col("_gt"), F.lit(GRAD)).otherwise(F.col("label"))) \
            .drop("_gt")


def label_gaps(grid: DataFrame, sid: str = "id", term: str = "termbnr") -> DataFrame:
    """After enrolment ('I'): summer absences -> 'NS', other absences -> 'B';
    after two consecutive breaks the next term becomes 'D' and labelling stops;
    it also stops at 'G'.  One ordered array per student folded with
    ``aggregate`` (state: enrolled, breaks, done, output)."""
    item = F.struct(F.col(term).cast("long").alias("t"), F.col("label").alias("l"))
    seq = grid.groupBy(sid).agg(F.array_sort(F.collect_list(item)).alias("_seq"))
    out_type = "array<struct<t:bigint,l:string>>"
    init = F.struct(F.lit(False).alias("enrolled"), F.lit(0).alias("breaks"), F.lit(False).alias("done"),
                    F.array().cast(out_type).alias("out"))

    def step(acc, x):
        lab, t = x["l"], x["t"]
        done, breaks, enrolled = acc["done"], acc["breaks"], acc["enrolled"]
        stop_now = ~done & ((lab == GRAD) | (breaks == 2))
        summer = (t % 100) == SUMMER
        new = (F.when(done, lab).when(lab == GRAD, lab).when(breaks == 2, F.lit(DROP))
                .when(~enrolled, lab)
                .when(lab == ABSENT, F.when(summer, F.lit(NO_SUMMER)).otherwise(F.lit(BREAK)))
                .otherwise(lab))
        active = ~done & ~stop_now & enrolled
        new_breaks = (F.when(~active, breaks)
                       .when((lab == ABSENT) & ~summer, breaks + 1)
                       .when(lab == ABSENT, breaks)
                       .otherwise(F.lit(0)))
        new_enrolled = enrolled | (~done & ~stop_now & (lab == INTENT))
        return F.struct(new_enrolled.alias("enrolled"), new_breaks.alias("breaks"),
                        (done | stop_now).alias("done"),
                        F.array_append(acc["out"], F.struct(t.alias("t"), new.alias("l"))).alias("out"))

    folded = seq.select(sid, F.aggregate("_seq", init, step)["out"].alias("_out"))
    e = folded.select(sid, F.explode("_out").alias("_e"))
    return e.select(sid, F.col("_e.t").alias(term), F.col("_e.l").alias("label"))


def edges(labels: DataFrame, sid: str = "id", term: str = "termbnr") -> DataFrame:
    """College transitions from the first 'I' up to the first 'G'/'D' (inclusive);
    NS/B/N carry the current college over, so they are dropped before pairing."""
    w_all = W.partitionBy(sid)
    first_i = F.min(F.when(F.col("label") == INTENT, F.col(term))).over(w_all)
    d = labels.withColumn("_fi", first_i).where(F.col("_fi").isNotNull() & (F.col(term) >= F.col("_fi")))
    stop = F.min(F.when(F.col("label").isin(GRAD, DROP), F.col(term))).over(w_all)
    d = d.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(term) <= F.col("_stop")))
    d = d.where(~F.col("label").isin(NO_SUMMER, BREAK, ABSENT))
    nxt = F.lead("label").over(W.partitionBy(sid).orderBy(term))
    p = d.select(sid, term, F.col("label").alias("src"), nxt.alias("dst"))
    return p.where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))


def flow(edge_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(weighted edges, per-node inflow/outflow)."""
    w = edge_rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    outflow = w.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("outflow"))
    inflow = w.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("inflow"))
    nodes = inflow.join(outflow, "node", "full_outer").fillna(0, ["inflow", "outflow"])
    return w, nodes


def flow_grid(edge_rows: DataFrame) -> DataFrame:
    """(src, dst, share) for every pair of nodes, zeros included: the long form
    of the matrix, built from the node table (statuses and majors, not rows)."""
    w = edge_rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    w = w.select("src", "dst", (F.col("weight") / F.sum("weight").over(W.partitionBy())).alias("share"))
    nodes = w.select("src").union(w.select("dst")).distinct()
    return (nodes.crossJoin(nodes.select(F.col("src").alias("dst"))).join(w, ["src", "dst"], "left")
                 .fillna(0.0, subset=["share"]))


def pivot_status(labels: DataFrame, terms: Sequence[int], sid: str = "id", term: str = "termbnr") -> DataFrame:
    """Student rows x term columns (explicit value list: no extra job, no pivot limit)."""
    return labels.groupBy(sid).pivot(term, [int(t) for t in terms]).agg(F.first("label"))
