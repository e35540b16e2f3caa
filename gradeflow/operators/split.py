"""Train/test splitting.

Splits are lazily filtered frames of one parent (or one frame with a
``split`` column); nothing is collected except small lists of distinct
split values (terms).
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from gradeflow.operators.prep import null_safe_join

HEAVY = 1 << 16  # rows of a user that are ranked together, about, at most

OPS: dict[str, Callable] = {"lt": operator.lt, "le": operator.le, "gt": operator.gt,
                            "ge": operator.ge, "eq": operator.eq, "ne": operator.ne}


class Span(NamedTuple):
    """Closed range of ordinals; ``last`` is None when it has no end."""
    first: int
    last: int | None

    def holds(self, c: Column) -> Column:
        inside = c >= self.first
        return inside if self.last is None else inside & (c <= self.last)


_FILTER = re.compile(r"(\d+)(?:-(\d+))?(?::(\d+)(?:-(\d+))?)?")


def parse_filter(spec: str) -> tuple[Span, Span]:
    """(cohorts, terms) of ``a-b``, ``a-b:c-d``, ``a:c`` and mixtures: a number
    without an end means "from here on", a missing term part every term."""
    m = _FILTER.fullmatch(spec.strip())
    if not m:
        raise ValueError(f"not a cohort/term filter: {spec!r}")
    a, b, c, d = (None if g is None else int(g) for g in m.groups())
    return Span(a, b), Span(c or 0, d)


def filter_mask(spec: str, cohort: str = "cohort", term: str = "termnum") -> Column:
    """NULL-safe: a NULL cohort or term fails the filter (lands in test)."""
    cohorts, terms = parse_filter(spec)
    return F.coalesce(cohorts.holds(F.col(cohort)) & terms.holds(F.col(term)), F.lit(False))


def split_filter(df: DataFrame, spec: str, cohort: str = "cohort", term: str = "termnum") -> DataFrame:
    return df.withColumn("split", F.when(filter_mask(spec, cohort, term), "train").otherwise("test"))


def split_data(df: DataFrame, specs: Sequence[str], cohort: str = "cohort", term: str = "termnum",
               mode: str = "default") -> DataFrame:
    """Several filters: train = any mask; test rows up to the oddball boundary
    (NULL cohort, or courses before enrolment) move to train.

    The boundary is the largest cohort a filter names: its end, or its start
    when it has no end.  ``mode="reference"``: test = union of complements, so a
    row matching one filter but not another is in both sides (two output rows),
    and a filter without an end puts the boundary behind every term."""
    cohorts = [parse_filter(s)[0] for s in specs]
    masks = [filter_mask(s, cohort, term) for s in specs]
    any_mask = F.lit(False)
    for m in masks:
        any_mask = any_mask | m
    if mode == "default":
        edge = max(c.first if c.last is None else c.last for c in cohorts)
        odd = F.coalesce(F.col(term) <= edge, F.lit(False))
        return df.withColumn("split", F.when(any_mask | odd, "train").otherwise("test"))
    if mode == "reference":
        open_ended = any(c.last is None for c in cohorts)
        odd = F.col(term).isNotNull() if open_ended else F.col(term) <= max(c.last for c in cohorts)
        all_mask = F.lit(True)
        for m in masks:
            all_mask = all_mask & m
        labels = F.array_compact(F.array(
            F.when(any_mask | (~all_mask & odd), "train"),
            F.when(~all_mask & ~odd, "test")))
        return df.withColumn("split", F.explode(labels))
    raise ValueError(f"unknown mode {mode!r}")


def next_term_split(df: DataFrame, t: int, term: str = "termnum",
                    window: int | None = None) -> tuple[DataFrame, DataFrame]:
    lo = F.lit(True) if window is None else (F.col(term) >= t - window)
    return df.where((F.col(term) < t) & lo), df.where(F.col(term) == t)


def window_split(df: DataFrame, t: int, w: int, term: str = "termnum"):
    return next_term_split(df, t, term, window=w)


def all_term_split(df: DataFrame, t: int, term: str = "termnum") -> DataFrame:
    """One train set (term < t), every later term tested; ``termnum`` travels with each row."""
    return df.withColumn("split", F.when(F.col(term) < t, "train").otherwise("test"))


def distinct_values(df: DataFrame, col: str) -> list:
    """Sorted distinct values of a low-cardinality split column (e.g. terms)."""
    return [r[0] for r in df.select(col).distinct().orderBy(col).collect()]


def splits(df: DataFrame, col: str, train_op: str = "lt", test_op: str = "eq",
           window: int | None = None) -> Iterator[tuple[object, DataFrame, DataFrame]]:
    """All splits over the distinct values of ``col``: (value, train, test),
    train = train_op(col, v) and col >= v - window (when a window is given)."""
    tr_op, te_op = OPS[train_op], OPS[test_op]
    c = F.col(col)
    for v in distinct_values(df, col):
        tm = tr_op(c, F.lit(v))
        if window is not None:
            tm = tm & (c >= v - window)
        yield v, df.where(tm), df.where(te_op(c, F.lit(v)))


def split_summary(df: DataFrame, col: str = "termnum", window: int | None = None) -> DataFrame:
    """Sizes of every (col < v, col == v) split in one job: counts per value,
    then a running sum over the (small) per-value table."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n_test"))
    lo = W.unboundedPreceding if window is None else -int(window)
    w = W.orderBy(col).rangeBetween(lo, -1)  # one row per distinct value
    return counts.select(col, F.coalesce(F.sum("n_test").over(w), F.lit(0)).alias("n_train"), "n_test")


def row_hash(seed: int, *cols: str) -> Column:
    """md5 of the seed and the key columns as text: a draw that depends on the
    row alone, on every cluster and in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]).cast("binary"))


def random_split(df: DataFrame, p: float, seed: int = 42, keys: Sequence[str] | None = None) -> DataFrame:
    """Exactly int(N * p + 1) rows (at most N) labelled train: those with the
    smallest hashes of (seed, key columns).

    Counts per hash prefix (65,536 at most) give the prefix at which the count
    is reached; only rows of that prefix are ranked, all others are labelled by
    comparison in one narrow pass."""
    keys = list(keys or df.columns)
    h = df.withColumn("_h", row_hash(seed, *keys)).withColumn("_p", F.substring("_h", 1, 4))
    counts = h.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    run = counts.withColumn("below", F.sum("n").over(W.orderBy("_p")) - F.col("n")) \
                .withColumn("total", F.sum("n").over(W.partitionBy()))
    take = F.floor(F.col("total") * F.lit(float(p)) + 1)
    edge = run.where((F.col("below") < take) & (F.col("below") + F.col("n") >= take)) \
              .select("_p", (take - F.col("below")).alias("need")).first()
    if edge is None:  # fewer rows than asked for
        return df.withColumn("split", F.lit("train"))
    at, need = F.lit(edge["_p"]), edge["need"]
    ranked = F.row_number().over(W.orderBy("_h", *keys)) <= need
    inside = h.where(F.col("_p") == at).withColumn("split", F.when(ranked, "train").otherwise("test"))
    outside = h.where(F.col("_p") != at).withColumn("split", F.when(F.col("_p") < at, "train").otherwise("test"))
    return outside.unionByName(inside).drop("_h", "_p")


def holdout_k(df: DataFrame, k: int, seed: int = 42, user: str = "sid", item: str = "cid",
              salts: int | None = None) -> DataFrame:
    """Hold out k pseudo-random ratings of each user (test), the rest train.

    Each (user, item) has a draw of its own, so different users hold out different
    items.  Rows are labelled themselves: of repeated pairs as many are held out as fall among the
    k, and a NULL user is a user like any other.  Rows are dealt once, by user, and ranked.  A user of more than
    ``HEAVY`` rows (with ``salts``: every user) is spread over several groups by item, so it is not sorted in one task: each
    group ranks its rows, the user's k-th smallest of the groups' candidates is the limit that labels all
    of them where they lie.  Draws are made after rows are dealt."""
    if salts is None:
        heavy = df.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HEAVY)  # few: a share of the rows each
        groups = F.broadcast(heavy.select(F.col(user).alias("_u"), F.ceil(F.col("_n") / F.lit(HEAVY)).alias("_groups")))
        h = df.join(groups, F.col(user).eqNullSafe(F.col("_u")), "left").drop("_u")
    else:
        h = df.withColumn("_groups", F.lit(salts))
    h = h.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(F.col(item), F.lit(seed + 1)), F.col("_groups")), F.lit(0)))
    h = h.repartition(user, "_salt")
    h = h.withColumn("_h", F.unhex(row_hash(seed, user, item))).withColumn("_x", F.xxhash64(*df.columns))
    h = h.withColumn("_r", F.row_number().over(W.partitionBy(user, "_salt").orderBy("_h", item, "_x")))
    # rows of one pair share the salt, so (draw, item, rank) tells all rows of a user apart, in the order of the draws
    h = h.withColumn("_at", F.when(F.col("_groups").isNotNull(), F.struct("_h", F.coalesce(F.col(item).cast("string"), F.lit("")), "_salt", "_r")))
    cand = h.where(F.col("_groups").isNotNull() & (F.col("_r") <= k)).select(user, "_at")
    last = cand.withColumn("_n", F.row_number().over(W.partitionBy(user).orderBy("_at"))).where(F.col("_n") <= k) \
               .groupBy(user).agg(F.max("_at").alias("_last"))
    out = null_safe_join(h, last if salts else F.broadcast(last), [user])  # a row a heavy user
    held = F.when(F.col("_groups").isNull(), F.col("_r") <= k).otherwise(F.col("_at") <= F.col("_last"))
    return out.withColumn("split", F.when(held, "test").otherwise("train")).select(*df.columns, "split")


def seed_unseen_items(train: DataFrame, test: DataFrame, k: int = 3, item: str = "cid",
                      order: Sequence[str] = ("termnum", "ord")) -> tuple[DataFrame, DataFrame]:
    """Items absent from train: their first k test instances move to train.

    Each test row is labelled once and both sides follow from the label, so a
    row is in one of them whatever its NULLs; a NULL item is an unseen item."""
    seen = train.select(F.col(item).alias("_item")).where("_item IS NOT NULL").distinct()
    w = W.partitionBy(item).orderBy(*order)
    labelled = (test.join(seen, F.col(item) == F.col("_item"), "left")
                    .withColumn("_move", F.col("_item").isNull() & (F.row_number().over(w) <= k)))
    return (train.unionByName(labelled.where("_move").select(*test.columns)),
            labelled.where("NOT _move").select(*test.columns))


def xy(df: DataFrame, target: str, features: Sequence[str] | None = None):
    feats = [c for c in (features or df.columns) if c != target]
    return df.select(*feats), df.select(target)
