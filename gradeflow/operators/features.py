"""Window and running aggregates.

Design rule for every "as of earlier terms" feature: aggregate to one row per
(entity, term) first (map-side combined, so a heavy user or course shrinks to
at most #terms rows), run the ordered window on that small table, and join the
result back on (entity, term).  Detail rows are never sorted inside one
window partition per entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from gradeflow.functions.scalars import safe_div

UNB = W.unboundedPreceding


def _running(key: str, term: str = "termnum"):
    return W.partitionBy(key).orderBy(term).rowsBetween(UNB, 0)


def _ordered(key: str, term: str = "termnum"):
    return W.partitionBy(key).orderBy(term)


# ---------------------------------------------------------------------------
# student side
# ---------------------------------------------------------------------------

def quality_points(df: DataFrame, sid="sid", term="termnum", chrs="chrs", grade="grdpts") -> DataFrame:
    """Row-level ``qpts = chrs * grdpts`` and the (sid, term) total ``term_qpts``."""
    qp = F.col(chrs) * F.col(grade)
    d = df.withColumn("qpts", qp)
    t = d.groupBy(sid, term).agg(F.sum("qpts").alias("term_qpts"))
    return d.join(t, [sid, term], "left")


def student_terms(df: DataFrame, sid="sid", term="termnum", chrs="chrs", grade="grdpts") -> DataFrame:
    """One row per (sid, term) with term / running totals, GPAs, lags and sterm."""
    t = df.groupBy(sid, term).agg(
        F.sum(F.col(chrs) * F.col(grade)).alias("term_qpts"),
        F.sum(chrs).alias("term_chrs"))
    run, o = _running(sid, term), _ordered(sid, term)
    t = (t.withColumn("total_qpts", F.sum("term_qpts").over(run))
          .withColumn("total_chrs", F.sum("term_chrs").over(run))
          .withColumn("term_gpa", safe_div("term_qpts", "term_chrs"))
          .withColumn("cum_gpa", safe_div("total_qpts", "total_chrs")))
    return t.select(
        "*",
        F.lag("term_gpa").over(o).alias("lterm_gpa"),
        F.lag("term_chrs").over(o).alias("lterm_chrs"),
        F.lag("cum_gpa").over(o).alias("lterm_cum_gpa"),
        F.lag("total_chrs").over(o).alias("lterm_total_chrs"),
        F.row_number().over(o).alias("sterm"))


def course_terms(df: DataFrame, cid="cid", term="termnum", grade="grdpts") -> DataFrame:
    """One row per (cid, term): enrollment, mean grade, running versions and lags."""
    t = df.groupBy(cid, term).agg(
        F.count(cid).alias("num_enrolled"),
        F.sum(grade).alias("term_grdpts_sum"))
    run, o = _running(cid, term), _ordered(cid, term)
    t = (t.withColumn("total_enrolled", F.sum("num_enrolled").over(run))
          .withColumn("total_grdpts_sum", F.sum("term_grdpts_sum").over(run))
          .withColumn("term_cgpa", safe_div("term_grdpts_sum", "num_enrolled"))
          .withColumn("cum_cgpa", safe_div("total_grdpts_sum", "total_enrolled")))
    return t.select(
        "*",
        F.lag("term_cgpa").over(o).alias("lterm_cgpa"),
        F.lag("cum_cgpa").over(o).alias("lterm_cum_cgpa"),
        F.lag("num_enrolled").over(o).alias("lterm_num_enrolled"),
        F.lag("total_enrolled").over(o).alias("lterm_total_enrolled"))


def student_totals(df, **kw) -> DataFrame:
    return student_terms(df, **kw).select("sid", "termnum", "term_qpts", "term_chrs",
                                          "total_qpts", "total_chrs")


def student_gpa(df, **kw) -> DataFrame:
    return student_terms(df, **kw).select("sid", "termnum", "term_gpa", "cum_gpa")


def student_lags(df, **kw) -> DataFrame:
    return student_terms(df, **kw).select("sid", "termnum", "lterm_gpa", "lterm_chrs",
                                          "lterm_cum_gpa", "lterm_total_chrs")


def student_term_no(df, **kw) -> DataFrame:
    return student_terms(df, **kw).select("sid", "termnum", "sterm")


def course_enroll(df, **kw) -> DataFrame:
    return course_terms(df, **kw).select("cid", "termnum", "num_enrolled", "total_enrolled")


def course_gpa(df, **kw) -> DataFrame:
    return course_terms(df, **kw).select("cid", "termnum", "term_cgpa", "cum_cgpa")


def course_lags(df, **kw) -> DataFrame:
    return course_terms(df, **kw).select("cid", "termnum", "lterm_cgpa", "lterm_cum_cgpa",
                                         "lterm_num_enrolled", "lterm_total_enrolled")


ENGINEERED = ["lterm_gpa", "lterm_cum_gpa", "total_chrs", "num_enrolled", "lterm_cgpa",
              "lterm_cum_cgpa", "total_enrolled", "term_chrs", "sterm"]


def engineer(df: DataFrame, keep_all: bool = False) -> DataFrame:
    """All student and course window features in one plan.

    Two (entity, term) aggregates, two ordered windows on those small tables,
    two joins back: the detail rows are shuffled once per entity key.
    ``num_enrolled``/``total_enrolled``/``total_chrs``/``term_chrs`` describe
    the current term, as in the original feature set.
    """
    st = student_terms(df)
    ct = course_terms(df)
    if not keep_all:
        st = st.select("sid", "termnum", "lterm_gpa", "lterm_cum_gpa", "total_chrs",
                       "term_chrs", "sterm")
        ct = ct.select("cid", "termnum", "num_enrolled", "lterm_cgpa", "lterm_cum_cgpa",
                       "total_enrolled")
    return df.join(st, ["sid", "termnum"], "left").join(ct, ["cid", "termnum"], "left")


# ---------------------------------------------------------------------------
# cold start
# ---------------------------------------------------------------------------

def first_terms(df: DataFrame, key: str, term: str = "termnum", name: str | None = None) -> DataFrame:
    return df.groupBy(key).agg(F.min(term).alias(name or f"_first_{key}"))


def mark_cold_start(df: DataFrame, user: str = "sid", item: str = "cid",
                    term: str = "termnum") -> DataFrame:
    """``cs`` ∈ {csb, css, csc, ncs}: is this the first term the user / item appears in?

    Replaces the per-term loop by one ``min(term)`` aggregate per key, joined
    back on the key (AQE broadcasts it when small, splits skewed keys otherwise).
    """
    fu = first_terms(df, user, term, "_fu")
    fi = first_terms(df, item, term, "_fi")
    d = df.join(fu, user, "left").join(fi, item, "left")
    cu = F.col(term) == F.col("_fu")
    ci = F.col(term) == F.col("_fi")
    cs = F.when(cu & ci, "csb").when(cu, "css").when(ci, "csc").otherwise("ncs")
    return d.withColumn("cs", cs).drop("_fu", "_fi")


def mark_cold(df: DataFrame, key: str, term: str = "termnum") -> DataFrame:
    """Boolean ``cs_<key>``: first term in which ``key`` appears."""
    f = first_terms(df, key, term, "_f")
    return df.join(f, key, "left").withColumn(f"cs_{key}", F.col(term) == F.col("_f")).drop("_f")


# ---------------------------------------------------------------------------
# prior statistics (expanding or w-term window, exclusive of the current term)
# ---------------------------------------------------------------------------

def _prior_frame(key: str | None, term: str, window: int | None):
    lo = UNB if window is None else -int(window)
    w = W.orderBy(term) if key is None else W.partitionBy(key).orderBy(term)
    return w.rangeBetween(lo, -1)


def prior_entity_stats(df: DataFrame, key: str, value: str = "grdpts", term: str = "termnum",
                       window: int | None = None, prefix: str | None = None) -> DataFrame:
    """(key, term) -> mean of ``value`` and row count over the key's earlier terms."""
    p = prefix or key
    t = df.groupBy(key, term).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"),
                                  F.count(F.lit(1)).alias("_c"))
    w = _prior_frame(key, term, window)
    return t.select(key, term,
                    safe_div(F.sum("_s").over(w), F.sum("_n").over(w)).alias(f"{p}_mean"),
                    F.sum("_c").over(w).alias(f"{p}_seen"))


def prior_global_stats(df: DataFrame, value: str = "grdpts", term: str = "termnum",
                       window: int | None = None) -> DataFrame:
    """term -> global mean over earlier terms.  At most #terms rows."""
    t = df.groupBy(term).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"),
                             F.count(F.lit(1)).alias("_c"))
    w = _prior_frame(None, term, window)
    return t.select(term, safe_div(F.sum("_s").over(w), F.sum("_n").over(w)).alias("global_mean"),
                    F.sum("_c").over(w).alias("global_seen"))


def prior_means(df: DataFrame, user: str = "sid", item: str = "cid", value: str = "grdpts",
                term: str = "termnum", window: int | None = None) -> DataFrame:
    """Attach user / item / global means as of each row's term (exclusive).

    One job for all terms in place of one fit per term.  The training set for
    term t is every row with term in [t-window, t) (all earlier terms when
    ``window`` is None); ``*_seen`` is NULL when the entity is absent there.
    """
    u = prior_entity_stats(df, user, value, term, window, "user")
    i = prior_entity_stats(df, item, value, term, window, "item")
    g = prior_global_stats(df, value, term, window)
    # the global table has one row per distinct term: bounded by the calendar
    return (df.join(u, [user, term], "left")
              .join(i, [item, term], "left")
              .join(F.broadcast(g), [term], "left"))


def balance_weights(df: DataFrame, y: str, name: str = "weight") -> DataFrame:
    """Row weight = smallest class count / own class count."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("_cnt"))
    least = counts.agg(F.min("_cnt")).first()[0]
    return df.join(counts.select(y, (F.lit(least) / F.col("_cnt")).alias(name)), y, "left")


def rmse_by_term(df: DataFrame, err: str = "error", term: str = "termnum") -> DataFrame:
    """Per-term RMSE and count, plus the running RMSE over terms in order."""
    t = df.groupBy(term).agg(F.sum(F.col(err) * F.col(err)).alias("sse"),
                             F.count(err).alias("n"))
    run = W.orderBy(term).rowsBetween(UNB, 0)  # one row per term
    return t.select(term, "n", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
                    F.sqrt(F.sum("sse").over(run) / F.sum("n").over(run)).alias("running_rmse"))


def decay_weighted_gpa(df: DataFrame, decay: float = 0.5, sid="sid", term="termnum",
                       chrs="chrs", grade="grdpts") -> DataFrame:
    """GPA over earlier terms with weight ``decay**(t - t')`` (recent terms count more).

    A fold over a student's terms (one entry a term): the weighted sums up to a term decay by the gap to
    the next, so that no power of a term number itself is taken and raw term codes work as
    well.  Rows without a term are left out."""
    t = df.where(F.col(term).isNotNull()).groupBy(sid, term).agg(
        F.coalesce(F.sum(F.col(chrs) * F.col(grade)), F.lit(0.0)).alias("q"), F.coalesce(F.sum(chrs), F.lit(0.0)).cast("double").alias("h"))
    kind = df.schema[term].dataType.simpleString()
    by_term = t.groupBy(sid).agg(F.sort_array(F.collect_list(F.struct(F.col(term).alias("t"), "q", "h"))).alias("s"))
    start = F.struct(F.lit(None).cast(kind).alias("t"), F.lit(0.0).alias("q"), F.lit(0.0).alias("h"),
                     F.array().cast(f"array<struct<t:{kind},q:double,h:double>>").alias("out"))

    def step(acc, x):
        fade = F.when(acc["t"].isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(float(decay)), (x["t"] - acc["t"]).cast("double")))
        q, h = acc["q"] * fade, acc["h"] * fade  # earlier terms as seen from this one
        return F.struct(x["t"].alias("t"), (q + x["q"]).alias("q"), (h + x["h"]).alias("h"),
                        F.concat(acc["out"], F.array(F.struct(x["t"].alias("t"), q.alias("q"), h.alias("h")))).alias("out"))
    folded = by_term.select(sid, F.explode(F.aggregate("s", start, step, lambda acc: acc["out"])).alias("o"))
    return folded.select(sid, F.col("o.t").alias(term), safe_div(F.col("o.q"), F.col("o.h")).alias("tw_gpa"))
