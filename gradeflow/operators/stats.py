"""Aggregations: imputation, scaling, error metrics and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from gradeflow.functions.scalars import clip, safe_div
from gradeflow.operators.prep import null_safe_join
from gradeflow.session import cut_lineage

# ---------------------------------------------------------------------------
# errors and metrics
# ---------------------------------------------------------------------------


def with_error(df: DataFrame, actual: str = "grdpts", pred: str = "pred",
               bounds: tuple[float, float] | None = (0.0, 4.0)) -> DataFrame:
    """``error = actual - clip(pred)`` (``pred`` itself stays unclipped), |e|, e²."""
    p = clip(pred, *bounds) if bounds else F.col(pred)
    e = F.col(actual) - p
    return (df.withColumn("error", e)
              .withColumn("abs_error", F.abs(F.col("error")))
              .withColumn("sq_error", F.col("error") * F.col("error")))


def metrics(df: DataFrame, err: str = "error") -> DataFrame:
    """One row: rmse, mae, mse, sse, n."""
    e = F.col(err)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                  F.avg(e * e).alias("mse"), F.sum(e * e).alias("sse"), F.count(e).alias("n"))


def eval_by(df: DataFrame, by: str = "termnum", err: str = "error", ddof: int = 0) -> DataFrame:
    """Per-group rmse, mae, std of |e| and count, plus the overall ``is_all`` row.

    One grouping-sets aggregate; the total row is labelled by ``grouping()``,
    so a NULL group key stays distinguishable from the total.
    """
    e = F.col(err)
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    return (df.groupingSets([[by], []], by)
              .agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                   std(F.abs(e)).alias("mae_std"), F.count(e).alias("counts"),
                   (F.grouping(by) == 1).alias("is_all")))


def eval_grid(df: DataFrame, y: str, x: str, err: str = "error") -> DataFrame:
    """RMSE and count for every (y, x) cell and both margins (cube)."""
    e = F.col(err)
    return (df.cube(y, x)
              .agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count(e).alias("n"),
                   (F.grouping(y) == 1).alias(f"all_{y}"), (F.grouping(x) == 1).alias(f"all_{x}")))


def rating_rmse(df: DataFrame, err: str = "error", rating: str = "grdpts") -> DataFrame:
    """sqrt(sum(e² · r) / sum(r)): squared error weighted by the rating itself."""
    e, r = F.col(err), F.col(rating)
    return df.agg(F.sqrt(safe_div(F.sum(e * e * r), F.sum(r))).alias("rating_weighted_rmse"))


def combine(per_group: DataFrame, metric: str = "rmse", n: str = "n") -> DataFrame:
    """Overall RMSE from per-group RMSE and counts: sqrt(sum(m² n) / sum(n))."""
    m = F.col(metric)
    return per_group.agg(F.sqrt(F.sum(m * m * F.col(n)) / F.sum(n)).alias(f"total_{metric}"),
                         F.sum(n).alias("n"))


# ---------------------------------------------------------------------------
# imputation
# ---------------------------------------------------------------------------

def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, n, q): exact interpolated quantiles, ``q[k]`` for probs[k].

    All columns in one long job: values are counted (combined map-side), the
    counts range-partitioned by (group, column, value), and running counts
    come from per-partition totals plus a window inside each partition, so no
    task holds a column.  The ranks around each position are then the least
    values whose running count exceeds them.  NULLs are left out; a column
    without values has no row."""
    by, keys = list(by), [*by, "column"]
    long = (df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
              .unpivot(by, list(cols), "column", "value").where(F.col("value").isNotNull()))
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    # partition ids must not change between the passes
    ranged = cut_lineage(counts.repartitionByRange(*keys, "value").withColumn("_pid", F.spark_partition_id()))
    per = ranged.groupBy(*keys, "_pid").agg(F.sum("n").alias("_t"))
    # one row per partition, group and column
    w = W.partitionBy(*keys)
    offsets = per.select(*keys, "_pid", F.sum("_t").over(w).alias("total"), F.coalesce(
        F.sum("_t").over(w.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    run = null_safe_join(ranged, offsets, [*keys, "_pid"], "left").withColumn(
        "upto", F.col("before") + F.sum("n").over(W.partitionBy(*keys, "_pid").orderBy("value")))
    aggs = []
    for k, p in enumerate(probs):
        at = (F.col("total") - 1) * F.lit(float(p))
        aggs += [F.min(F.when(F.col("upto") > F.floor(at), F.col("value"))).alias(f"_lo{k}"),
                 F.min(F.when(F.col("upto") > F.ceil(at), F.col("value"))).alias(f"_hi{k}")]
    out = run.groupBy(*keys).agg(F.first("total").alias("n"), *aggs)
    qs = []
    for k, p in enumerate(probs):
        at, lo, hi = (F.col("n") - 1) * F.lit(float(p)), F.col(f"_lo{k}"), F.col(f"_hi{k}")
        qs.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi))
    return out.select(*keys, "n", F.array(*qs).alias("q"))


def earlier_medians(df: DataFrame, cols: Sequence[str], term: str, terms: Sequence[int]) -> dict:
    """{t: {column: exact median of the rows with a term before t}} for all ``terms`` from one count of the values.

    As ``exact_quantiles``, with one running count per term instead of one; NULLs are left out, a column without
    values before t is None."""
    ks, half = range(len(terms)), F.lit(0.5)
    long = (df.select(term, *[F.col(c).cast("double").alias(c) for c in cols])
              .unpivot([term], list(cols), "column", "value").where(F.col("value").isNotNull()))
    counts = long.groupBy("column", "value").agg(*[F.count(F.when(F.col(term) < F.lit(t), 1)).alias(f"n{k}") for k, t in enumerate(terms)])
    # partition ids must not change between the passes
    ranged = cut_lineage(counts.repartitionByRange("column", "value").withColumn("_pid", F.spark_partition_id()))
    per = ranged.groupBy("column", "_pid").agg(*[F.sum(f"n{k}").alias(f"_t{k}") for k in ks])
    # one row per partition and column
    w = W.partitionBy("column")
    ahead = w.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select("column", "_pid", *[F.sum(f"_t{k}").over(w).alias(f"total{k}") for k in ks],
                         *[F.coalesce(F.sum(f"_t{k}").over(ahead), F.lit(0)).alias(f"before{k}") for k in ks])
    inside = W.partitionBy("column", "_pid").orderBy("value")
    run = ranged.join(offsets, ["column", "_pid"]).select("column", "value", *[f"total{k}" for k in ks], *[
        (F.col(f"before{k}") + F.sum(f"n{k}").over(inside)).alias(f"upto{k}") for k in ks])
    aggs = []
    for k in ks:
        at = (F.col(f"total{k}") - 1) * half
        aggs += [F.first(f"total{k}").alias(f"total{k}"), F.min(F.when(F.col(f"upto{k}") > F.floor(at), F.col("value"))).alias(f"_lo{k}"),
                 F.min(F.when(F.col(f"upto{k}") > F.ceil(at), F.col("value"))).alias(f"_hi{k}")]
    out = run.groupBy("column").agg(*aggs)
    qs = []
    for k in ks:
        at, lo, hi = (F.col(f"total{k}") - 1) * half, F.col(f"_lo{k}"), F.col(f"_hi{k}")
        q = F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)
        qs.append(F.when(F.col(f"total{k}") > 0, q).alias(f"q{k}"))
    got = {r["column"]: r for r in out.select("column", *qs).collect()}  # one row per column
    return {t: {c: got[c][f"q{k}"] if c in got else None for c in cols} for k, t in enumerate(terms)}


_AGG = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "mode": F.mode,
}


def impute_values(df: DataFrame, cols: Sequence[str], method: str = "median") -> dict:
    """Column statistics in one job (a row per column, or a single row, comes back)."""
    if method == "median":
        got = {r["column"]: r["q"][0] for r in exact_quantiles(df, cols, [0.5]).collect()}
        return {c: got.get(c) for c in cols}
    agg = _AGG[method]
    row = df.agg(*[agg(c).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def impute(df: DataFrame, cols: Sequence[str], method: str = "median",
           all_null: str = "drop", test: DataFrame | None = None):
    """Fill NULLs with a statistic of ``df`` (the train side when ``test`` is given).

    ``all_null``: what to do with a column that is entirely NULL — ``drop`` it,
    ``raise``, or ``ignore`` (leave it). Returns (filled df[, filled test], values).
    """
    values = impute_values(df, cols, method)
    empty = [c for c, v in values.items() if v is None]
    if empty and all_null == "raise":
        raise ValueError(f"all values NULL in {empty}")
    fill = {c: v for c, v in values.items() if v is not None}
    out = df.fillna(fill) if fill else df
    t = test.fillna(fill) if (test is not None and fill) else test
    if empty and all_null == "drop":
        out = out.drop(*empty)
        t = t.drop(*empty) if t is not None else None
    return (out, values) if test is None else (out, t, values)


# ---------------------------------------------------------------------------
# z-score
# ---------------------------------------------------------------------------

def scale_params(df: DataFrame, cols: Sequence[str]) -> dict:
    """Mean and population std per column, fitted by ONE aggregate (a single
    row reaches the driver, like an ML ``fit``).  A zero std becomes 1, the
    rule scikit-learn uses, so constant columns map to 0."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        sd = row[f"{c}__std"]
        out[c] = (row[f"{c}__mean"], 1.0 if (sd is None or sd == 0) else sd)
    return out


def apply_scale(df: DataFrame, params: dict, cols: Sequence[str] | None = None,
                inverse: bool = False) -> DataFrame:
    """(x - mean) / std, or its inverse, as column expressions."""
    cols = list(cols or params)
    out = []
    for c in df.columns:
        if c in cols:
            m, s = params[c]
            m = F.lit(m).cast("double")
            s = F.lit(float(s))
            out.append(((F.col(c) * s + m) if inverse else ((F.col(c) - m) / s)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def scale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None):
    """Z-score ``df``; statistics from ``fit_on`` (default: ``df`` itself)."""
    params = scale_params(fit_on if fit_on is not None else df, cols)
    return apply_scale(df, params, cols), params


def unscale(df: DataFrame, params: dict, cols: Sequence[str] | None = None) -> DataFrame:
    return apply_scale(df, params, cols, inverse=True)


# ---------------------------------------------------------------------------
# reports
# ---------------------------------------------------------------------------

def cold_summary(df: DataFrame, cs: str = "cs") -> DataFrame:
    """Counts and percentages of cold-start kinds (one row)."""
    c = F.col(cs)
    n = F.count(F.lit(1))
    cold = F.count_if(c != "ncs")
    return df.agg(
        n.alias("n"), cold.alias("cold"), F.count_if(c == "ncs").alias("not_cold"),
        (100.0 * cold / n).alias("pct_cold"),
        F.count_if(c == "csb").alias("both"), F.count_if(c == "css").alias("student_only"),
        F.count_if(c == "csc").alias("course_only"))


def cold_by_term(df: DataFrame, cs: str = "cs", term: str = "termnum") -> DataFrame:
    """Per term: cold and not-cold counts and cold percentage."""
    c = F.col(cs)
    return df.groupBy(term).agg(
        F.count_if(c != "ncs").alias("cs"), F.count_if(c == "ncs").alias("ncs"),
        (100.0 * F.count_if(c != "ncs") / F.count(F.lit(1))).alias("pct_cs"))


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Confusion counts with both margins (cube)."""
    return (df.cube(label, pred).agg(F.count(F.lit(1)).alias("n"),
                                    (F.grouping(label) == 1).alias("all_label"),
                                    (F.grouping(pred) == 1).alias("all_pred")))


def class_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and hard-label ROC AUC ((TPR + TNR) / 2) for class 1."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    tp, fp = F.count_if(y & p), F.count_if(~y & p)
    fn, tn = F.count_if(y & ~p), F.count_if(~y & ~p)
    a = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    prec = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    tnr = safe_div(F.col("tn"), F.col("tn") + F.col("fp"))
    return a.select("tp", "fp", "fn", "tn", prec.alias("precision"), rec.alias("recall"),
                    safe_div(2 * prec * rec, prec + rec).alias("f1"),
                    ((rec + tnr) / 2).alias("roc_auc"))


# Grade-point bin edges used by the prediction histogram.
GRADE_BINS = [0.0, 0.7, 1.3, 1.7, 2.2, 2.5, 2.8, 3.1, 3.4, 3.7, 4.0]


def bin_index(col, edges: Sequence[float] = GRADE_BINS) -> Column:
    """Bucket number i with edges[i] <= x < edges[i+1]; the last bucket includes its top."""
    c = F.col(col) if isinstance(col, str) else col
    expr = F.when(c.isNull(), F.lit(None))
    for i in range(len(edges) - 1):
        hi = edges[i + 1]
        cond = (c <= hi) if i == len(edges) - 2 else (c < hi)
        expr = expr.when((c >= edges[i]) & cond, F.lit(i))
    return expr.cast("int")


def pred_hist(df: DataFrame, term: str = "termnum", actual: str = "grdpts", pred: str = "pred",
              edges: Sequence[float] = GRADE_BINS) -> DataFrame:
    """Per term: how many actual and predicted values fall in each grade bin."""
    a = df.select(term, F.lit("actual").alias("kind"), bin_index(actual, edges).alias("bin"))
    p = df.select(term, F.lit("predicted").alias("kind"), bin_index(pred, edges).alias("bin"))
    # like a histogram, values outside [edges[0], edges[-1]] are not counted
    return (a.unionByName(p).where(F.col("bin").isNotNull())
             .groupBy(term, "kind", "bin").agg(F.count(F.lit(1)).alias("n")))


QUARTILES = (0.25, 0.5, 0.75)


def _quartile_cols() -> list[Column]:
    return [F.col("q")[k].alias(name) for k, name in enumerate(("q25", "q50", "q75"))]


def error_quantiles(df: DataFrame, by: str, err: str = "error") -> DataFrame:
    """min, quartiles (exact, interpolated) and max of the error per group."""
    e = F.col(err)
    ends = df.groupBy(by).agg(F.min(e).alias("min"), F.max(e).alias("max"), F.count(e).alias("n"))
    q = exact_quantiles(df, [err], QUARTILES, [by]).select(by, "q")
    return null_safe_join(ends, q, [by], "left").select(by, "n", "min", *_quartile_cols(), "max")


def describe(df: DataFrame, cols: Sequence[str], lo: float | None = None,
             hi: float | None = None) -> DataFrame:
    """count/mean/std/min/quartiles/max per column (long form), values outside
    [lo, hi] excluded as outliers when bounds are given."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    for c in cols:
        ok = F.lit(True)
        if lo is not None:
            ok = ok & (F.col(c) >= lo)
        if hi is not None:
            ok = ok & (F.col(c) <= hi)
        x = x.withColumn(c, F.when(ok, F.col(c)))
    return _describe(x, [], cols)


def _describe(df: DataFrame, by: Sequence[str], cols: Sequence[str], name: str = "column") -> DataFrame:
    """One unpivot and one aggregate for the moments, one exact quantile job."""
    v = F.col("value")
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(by), list(cols), "column", "value")
    keys = [*by, "column"]
    stats = long.groupBy(*keys).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                                    F.min(v).alias("min"), F.max(v).alias("max"))
    q = exact_quantiles(df, cols, QUARTILES, by).drop("n")
    return null_safe_join(stats, q, keys, "left").select(
        *by, F.col("column").alias(name), "count", "mean", "std", "min", *_quartile_cols(), "max")


def avg_importance(df: DataFrame, by: Sequence[str] = ("feature",), imp: str = "importance",
                   n: str = "test_count") -> DataFrame:
    """Test-count weighted mean importance."""
    i, w = F.col(imp), F.col(n)
    return df.groupBy(*by).agg((F.sum(i * w) / F.sum(w)).alias("importance"))


def all_null_cols(df: DataFrame, cols: Sequence[str], by: str | None = None) -> DataFrame:
    """Which columns are entirely NULL (per ``by`` group): one aggregate for all
    columns, returned long (by, column, all_null)."""
    aggs = [F.count(c).alias(c) for c in cols]
    a = df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)
    keep = [by] if by else []
    stacked = a.unpivot(keep, list(cols), "column", "n") if keep else a.unpivot([], list(cols), "column", "n")
    return stacked.select(*keep, "column", (F.col("n") == 0).alias("all_null"))


def encode_term(df: DataFrame, how: str = "onehot", term: str = "termnum", offset: int = 0) -> DataFrame:
    """Time as a feature: one-hot (index offset + term, value 1) or one real
    feature (index offset, value = term)."""
    if how == "onehot":
        return df.withColumn("term_idx", (F.col(term) + F.lit(offset)).cast("long")) \
                 .withColumn("term_val", F.lit(1.0))
    if how == "real":
        return df.withColumn("term_idx", F.lit(offset).cast("long")) \
                 .withColumn("term_val", F.col(term).cast("double"))
    raise ValueError(f"unknown term encoding {how!r}")


def leaderboard(results: dict, err: str = "error") -> DataFrame:
    """Methods ranked by overall RMSE (numeric order); ``results`` maps name -> frame."""
    parts = [d.agg(F.lit(name).alias("method"), F.sqrt(F.avg(F.col(err) * F.col(err))).alias("rmse"),
                   F.count(F.lit(1)).alias("n")) for name, d in results.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    # one row per method
    return u.withColumn("rank", F.rank().over(W.orderBy("rmse", "method")).cast("long"))


def top_feature_series(df: DataFrame, k: int = 10, term: str = "termnum", feature: str = "feature",
                       imp: str = "importance") -> DataFrame:
    """Keep the importance series of the k features with the highest mean
    importance in the first term (ties by name)."""
    first = df.agg(F.min(term)).first()[0]
    top = (df.where(F.col(term) == first).groupBy(feature).agg(F.avg(imp).alias("_m"))
             .orderBy(F.col("_m").desc(), F.col(feature)).limit(k).select(feature))
    return df.join(top, feature, "left_semi")


def importance_ts(df: DataFrame, term: str = "termnum", feature: str = "feature",
                  imp: str = "importance") -> DataFrame:
    """Mean importance per (term, feature) with the feature's first-term value,
    for ordering series by their starting importance."""
    t = df.groupBy(term, feature).agg(F.avg(imp).alias("importance"))
    w = W.partitionBy(feature).orderBy(term)
    return t.withColumn("first_importance", F.first("importance").over(w.rowsBetween(W.unboundedPreceding, 0)))


def cold_summary_by(df: DataFrame, by: str = "termnum", cs: str = "cs") -> DataFrame:
    """Cold-start counts per group plus the overall row (grouping sets)."""
    c = F.col(cs)
    n = F.count(F.lit(1))
    cold = F.count_if(c != "ncs")
    return (df.groupingSets([[by], []], by).agg(
        n.alias("n"), cold.alias("cold"), F.count_if(c == "ncs").alias("not_cold"),
        (100.0 * cold / n).alias("pct_cold"), F.count_if(c == "csb").alias("both"),
        F.count_if(c == "css").alias("student_only"), F.count_if(c == "csc").alias("course_only"),
        (F.grouping(by) == 1).alias("is_all")))


def grouped_describe(df: DataFrame, group: str, metrics: Sequence[str]) -> DataFrame:
    """count/mean/std/min/quartiles/max of several metrics per group, long form
    (group, metric, ...)."""
    return _describe(df, [group], metrics, "metric")


def split_shares(df: DataFrame, cohort: str = "cohort") -> DataFrame:
    """For each cohort boundary c: share of rows with cohort <= c (train) and the rest."""
    counts = df.groupBy(cohort).agg(F.count(F.lit(1)).alias("n"))
    # one row per cohort value
    run = F.sum("n").over(W.orderBy(cohort).rowsBetween(W.unboundedPreceding, 0))
    tot = F.sum("n").over(W.partitionBy())
    return counts.select(cohort, "n", (run / tot).alias("train_share"), (1 - run / tot).alias("test_share"))


GRAD_METRICS = ["years", "cum_gpa", "n_terms", "credits_per_term", "summer_credits"]


def grad_stats(degrees: DataFrame, students: DataFrame, ratings: DataFrame,
               deans_gpa: float = 3.5, on_time_years: float = 4.0) -> DataFrame:
    """Describe graduates (all / within ``on_time_years`` / longer / GPA >= deans_gpa).

    Years count half-years from the cohort term to the graduation term
    (spring and summer = first half, fall = second half), inclusive.
    """
    s = students.groupBy("id").agg(
        F.min("cohort").alias("cohort"), F.count(F.lit(1)).alias("n_terms"),
        F.sum("term_earn_hrs").alias("hrs"),
        F.sum(F.when(F.col("termbnr") % 100 == 40, F.col("term_earn_hrs"))).alias("summer_credits"))
    g = ratings.groupBy("sid").agg((F.sum(F.col("chrs") * F.col("grdpts")) / F.sum("chrs")).alias("cum_gpa"))

    def half(t):
        return F.floor(F.col(t) / 100) * 2 + F.when(F.col(t) % 100 == 70, 1).otherwise(0)

    d = (degrees.join(s, "id").join(g, degrees["id"] == g["sid"], "left")
         .select("id", ((half("gradterm") - half("cohort") + 1) / 2.0).alias("years"), "cum_gpa",
                 F.col("n_terms").cast("double").alias("n_terms"),
                 (F.col("hrs") / F.col("n_terms")).alias("credits_per_term"), "summer_credits"))
    grp = F.array_compact(F.array(F.lit("all"),
                                  F.when(F.col("years") <= on_time_years, "le4").otherwise("gt4"),
                                  F.when(F.col("cum_gpa") >= deans_gpa, "deans")))
    d = d.withColumn("grp", F.explode(grp))
    return grouped_describe(d.select("grp", *GRAD_METRICS), "grp", GRAD_METRICS)
