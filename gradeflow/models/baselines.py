"""Baseline predictors as Spark jobs.

The SQL-expressible baselines run for *all* terms in one job through the
prior-statistics windows; the per-term (train, test) versions are thin
wrappers for use inside ``rolling_eval``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.scalars import clip
from gradeflow.operators.features import prior_means
from gradeflow.operators.split import row_hash
from gradeflow.operators.stats import with_error


def mean_of_means_all_terms(df: DataFrame, user="sid", item="cid", value="grdpts",
                            term="termnum", window: int | None = None,
                            fallback: str = "zero", cold_start: bool = True) -> DataFrame:
    """Next-term prediction (global + user mean + item mean) / 3 for every term.

    A missing user/item mean contributes 0 (``fallback="zero"``, the original
    rule) or the global mean (``fallback="global"``).  Rows of a term without
    any training rows are not predicted.  ``cold_start=False`` keeps only rows
    whose user and item both appear in the training window.
    Output: input columns + user_mean, item_mean, global_mean, pred, error.
    """
    d = prior_means(df, user, item, value, term, window)
    g = F.col("global_mean")
    fb = F.lit(0.0) if fallback == "zero" else g
    pred = (F.coalesce(g, F.lit(0.0)) + F.coalesce(F.col("user_mean"), fb)
            + F.coalesce(F.col("item_mean"), fb)) / 3.0
    d = d.where(F.col("global_seen").isNotNull())
    if not cold_start:
        d = d.where(F.col("user_seen").isNotNull() & F.col("item_seen").isNotNull())
    return with_error(d.withColumn("pred", pred), value, "pred")


def global_mean_all_terms(df: DataFrame, value="grdpts", term="termnum",
                          window: int | None = None) -> DataFrame:
    """Predict the training mean for every later-term row (one job)."""
    from gradeflow.operators.features import prior_global_stats
    g = prior_global_stats(df, value, term, window)
    d = df.join(F.broadcast(g), term, "left").where(F.col("global_seen").isNotNull())
    return with_error(d.withColumn("pred", F.col("global_mean")), value, "pred")


# -- per-split baselines: method(train, test) -> test + pred ------------------

def global_mean(train: DataFrame, test: DataFrame, value="grdpts") -> DataFrame:
    """Training mean (one scalar aggregate) for every test row."""
    mu = train.agg(F.avg(value)).first()[0]
    return test.withColumn("pred", F.lit(mu).cast("double"))


def uniform_draw(seed: int, *keys: str) -> Column:
    """Uniform in [0, 1): 52 bits of the md5 of (seed, keys), so that a row draws
    the same value on any cluster, in a retried stage and in another engine."""
    return F.conv(F.substring(row_hash(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def normal_draw(seed: int, *keys: str) -> Column:
    """Standard normal by the Box-Muller transform of two independent draws."""
    u, v = uniform_draw(seed, *keys), uniform_draw(seed + 1, *keys)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)


DRAW_KEYS = ("sid", "cid", "termnum")


def uniform_baseline(train: DataFrame, test: DataFrame, value="grdpts", seed: int = 42,
                     keys=DRAW_KEYS) -> DataFrame:
    """Uniform draw in [train min, train max]."""
    lo, hi = train.agg(F.min(value), F.max(value)).first()
    return test.withColumn("pred", F.lit(float(lo)) + F.lit(float(hi - lo)) * uniform_draw(seed, *keys))


def normal_baseline(train: DataFrame, test: DataFrame, value="grdpts", seed: int = 42,
                    keys=DRAW_KEYS) -> DataFrame:
    """Normal(mean, std/sqrt(n)) of the training values (sample std)."""
    mu, sd, n = train.agg(F.avg(value), F.stddev_samp(value), F.count(value)).first()
    se = (sd or 0.0) / (n ** 0.5)
    return test.withColumn("pred", F.lit(float(mu)) + F.lit(float(se)) * normal_draw(seed, *keys))


def gauss_baseline(test: DataFrame, mu: float = 2.0, sd: float = 1.0, seed: int = 42,
                   bounds=(0.0, 4.0), keys=DRAW_KEYS) -> DataFrame:
    """Normal(2, 1) draws clipped to [0, 4]."""
    return test.withColumn("pred", clip(F.lit(mu) + F.lit(sd) * normal_draw(seed, *keys), *bounds))


def mean_of_means(train: DataFrame, test: DataFrame, user="sid", item="cid", value="grdpts",
                  fallback: str = "zero") -> DataFrame:
    """(global + user mean + item mean) / 3 fitted on ``train``; joins, no collect."""
    um = train.groupBy(user).agg(F.avg(value).alias("_um"))
    im = train.groupBy(item).agg(F.avg(value).alias("_im"))
    mu = train.agg(F.avg(value)).first()[0]
    g = F.lit(float(mu))
    fb = F.lit(0.0) if fallback == "zero" else g
    d = test.join(um, user, "left").join(im, item, "left")
    return d.withColumn("pred", (g + F.coalesce("_um", fb) + F.coalesce("_im", fb)) / 3.0) \
            .drop("_um", "_im")


def fill_cells(pairs: DataFrame, ratings: DataFrame, user="sid", item="cid", value="grdpts") -> DataFrame:
    """Fill requested (user, item) cells from row mean, column mean and global mean (/3)."""
    return mean_of_means(ratings, pairs, user, item, value, fallback="zero").withColumnRenamed("pred", "fill")
