"""Documented exploratory analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from gradeflow.operators.ids import build_idmap
from gradeflow.operators.prep import null_safe_join


def bipartite_edges(courses: DataFrame, sid: str = "id",
                    instr=("instr_lname", "instr_fname")) -> DataFrame:
    """Student-instructor edges (records per pair) with both endpoint degrees.
    Records without an instructor are not edges."""
    instr = list(instr)
    c = courses.where(F.col(instr[0]).isNotNull())
    e = c.groupBy(sid, *instr).agg(F.count(F.lit(1)).alias("weight"))
    sdeg = e.groupBy(sid).agg(F.count(F.lit(1)).alias("student_degree"))
    ideg = e.groupBy(*instr).agg(F.count(F.lit(1)).alias("instr_degree"))
    return e.join(sdeg, sid).join(ideg, instr)


def major_flow(students: DataFrame, sid: str = "id", term: str = "termbnr",
               major: str = "pmajr") -> DataFrame:
    """Counts of major changes between consecutive attended terms."""
    prev = F.lag(major).over(W.partitionBy(sid).orderBy(term))
    t = students.select(sid, F.col(major).alias("to_major"), prev.alias("from_major"))
    return (t.where(F.col("from_major").isNotNull() & (F.col("from_major") != F.col("to_major")))
             .groupBy("from_major", "to_major").agg(F.count(F.lit(1)).alias("n")))


def bottleneck_honeypot(graded: DataFrame, students: DataFrame, sid: str = "id", term: str = "termbnr",
                        course: str = "cnum", major: str = "pmajr", fail_below: float = 1.0,
                        excel_from: float = 3.67) -> DataFrame:
    """Per course: how often failing it is followed by a major change
    (bottleneck) and how often excelling in it is (honeypot)."""
    nxt = F.lead(major).over(W.partitionBy(sid).orderBy(term))
    st = students.select(sid, term, major, nxt.alias("_next"))
    j = graded.where(F.col("grdpts").isNotNull()).join(st, [sid, term])
    switched = F.col("_next").isNotNull() & (F.col("_next") != F.col(major))
    fail = F.col("grdpts") < fail_below
    excel = F.col("grdpts") >= excel_from
    a = j.groupBy(course).agg(
        F.count_if(fail).alias("n_fail"), F.count_if(fail & switched).alias("n_fail_switch"),
        F.count_if(excel).alias("n_excel"), F.count_if(excel & switched).alias("n_excel_switch"))
    return a.select("*", F.try_divide(F.col("n_fail_switch"), F.col("n_fail")).alias("bottleneck_rate"),
                    F.try_divide(F.col("n_excel_switch"), F.col("n_excel")).alias("honeypot_rate"))


def entry_correlations(term_gpa: DataFrame, admissions: DataFrame) -> DataFrame:
    """Pearson correlation of entry scores with term GPA (one row)."""
    j = term_gpa.join(admissions.select(F.col("id").alias("sid"), "hsgpa", "sat_total_1600"), "sid")
    return j.agg(F.corr("hsgpa", "term_gpa").alias("corr_hsgpa"),
                 F.corr("sat_total_1600", "term_gpa").alias("corr_sat"),
                 F.count(F.lit(1)).alias("n"))


def entity_term_stats(graded: DataFrame, term: str = "termnum", disc: str = "disc",
                      entities=(("n_students", ("id",)), ("n_courses", ("cnum",)), ("n_instructors", ("instr_lname", "instr_fname")))) -> DataFrame:
    """Per term and discipline (with rollup totals): distinct students, courses,
    instructors, records and mean grade.

    Distinct counts are exact: entities get contiguous ids, each (term, discipline, range of ids)
    one bitmap, and totals are ORs of bitmaps, so no detail row is repeated per total.  An entity
    with a NULL part is not counted."""
    kinds = graded.select(term, disc).schema
    sets = [[term, disc], [term], []]

    def totals(parts: DataFrame, extra: list[str], *aggs) -> DataFrame:
        """Aggregates of partial rows per (term, disc), per term and over all."""
        return parts.groupingSets([[*(F.col(c) for c in g), *(F.col(c) for c in extra)] for g in sets], term, disc, *extra).agg(
            *aggs, (F.grouping(term) == 1).alias("all_terms"), (F.grouping(disc) == 1).alias("all_discs"))
    keys = [term, disc, "all_terms", "all_discs"]
    base = graded.groupBy(term, disc).agg(F.count(F.lit(1)).alias("c"), F.sum("grdpts").alias("s"), F.count("grdpts").alias("g"))
    out = totals(base, [], F.sum("c").alias("n_records"), F.try_divide(F.sum("s"), F.sum("g")).alias("mean_grade"))
    for name, cols in entities:
        known = graded.dropna(subset=list(cols)).select(term, disc, *cols)
        at = build_idmap(known, list(cols), "_at")
        bits = known.join(at, list(cols)).groupBy(term, disc, F.expr("bitmap_bucket_number(_at)").alias("_range")).agg(
            F.expr("bitmap_construct_agg(bitmap_bit_position(_at)) AS bits"))
        ranges = totals(bits, ["_range"], F.expr("bitmap_count(bitmap_or_agg(bits)) AS n"))
        counts = ranges.groupBy(*keys).agg(F.sum("n").alias(name))
        out = null_safe_join(out, counts, keys).withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out.select(F.col(term).cast(kinds[0].dataType), F.col(disc).cast(kinds[1].dataType), *[n for n, _ in entities],
                      "n_records", "mean_grade", "all_terms", "all_discs")


def sequence_patterns(ratings: DataFrame, min_support: float = 0.1, max_len: int = 3,
                      sid: str = "sid", term: str = "termnum") -> DataFrame:
    """Frequent sequences of per-term itemsets (course level + grade band) with PrefixSpan."""
    from pyspark.ml.fpm import PrefixSpan
    band = (F.when(F.col("grdpts") >= 3.67, "A").when(F.col("grdpts") >= 2.67, "B")
             .when(F.col("grdpts") >= 1.67, "C").otherwise("DF"))
    item = F.concat(F.substring("cid", 1, 1), F.lit(":"), band)
    per_term = ratings.groupBy(sid, term).agg(F.array_sort(F.collect_set(item)).alias("items"))
    seqs = per_term.groupBy(sid).agg(F.array_sort(F.collect_list(F.struct(term, "items"))).alias("_s"))
    seqs = seqs.select(F.transform("_s", lambda x: x["items"]).alias("sequence"))
    ps = PrefixSpan(minSupport=min_support, maxPatternLength=max_len, sequenceCol="sequence")
    return ps.findFrequentSequentialPatterns(seqs)
