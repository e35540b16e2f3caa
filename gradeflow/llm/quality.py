"""Quality rules with robust multivariate outliers (operator 5, native).

Statistics are array expressions over whole texts.  Transformed statistic
vectors get a minimum-covariance-determinant estimate per language and source:
from a coordinate-wise median start, concentration steps refit mean and
covariance on the 75 % of rows with the least Mahalanobis distance until the
determinants settle.  Steps are aggregates over the small statistics table:
a histogram of distances gives the subset's edge (no sort of a group), sums of
products give the covariance, and the inverse Cholesky factor is a column
expression on the one-row-per-group estimate table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import cut, write_scratch

BLANK = " \t\n\x0b\f\r"
SUBSET = 0.75          # share of rows a concentration step keeps
LEAST_ROWS = 100       # smaller groups use the estimate of their language
STEPS, SETTLED = 12, 1e-3
BINS = 50              # histogram bins per unit of ln(distance): 2 % wide
#: Chi-square quantiles for the five features: the median and the limit
#: (0.999999), fixed values.
CHI_MEDIAN, CHI_LIMIT = 4.351, 35.888
#: One line that occurs twice is ordinary in a text of any length: repetition
#: is counted beyond one duplicate line, and beyond the words of a ten-word line
#: and its copy.
ORDINARY_LINES, ORDINARY_REPEATS = 1, 20
#: Transformed statistics and the least standard deviation each is given, so
#: that a statistic that is zero almost everywhere keeps a scale.  Where a group
#: repeats nothing, 10 % of the words repeated beyond the ordinary line reach
#: the limit on their own, as do 6 duplicate lines in 100 words.
FLOORS = {"x_length": 0.5, "x_word": 0.15, "x_symbols": 0.5, "x_lines": 0.3, "x_repeats": 0.4}
X = tuple(FLOORS)
P = len(X)


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    base_failed to the rows, leaving the text out.

    Null and empty texts have no words and fail the base rules.  The columns
    are computed in steps, each referring to the one before by name."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(t, F.lit(BLANK))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    df = df.select(*[c for c in df.columns if c != text],
                   F.when(bare == "", F.array().cast("array<string>")).otherwise(
                       F.split(bare, r"[\x20\x09-\x0D]+", -1)).alias("__w"),
                   F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                   lines.alias("__lines"))
    w = F.col("__w")
    three = F.when(F.size(w) < 3, F.array().cast("array<string>")).otherwise(F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2))))
    df = df.withColumns({
        "n_words": F.size(w).cast("long"), "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), "__three": three})
    # only texts with a repeated window are sorted: windows beside an equal one
    # in sorted order are the repeated ones
    df = df.withColumn("__sorted", F.when(
        F.size(F.array_distinct("__three")) < F.size("__three"),
        F.sort_array(F.transform("__three", lambda x, i: F.struct(x.alias("w"), i.alias("i"))))))
    s = F.col("__sorted")
    df = df.withColumn("__at", F.sort_array(F.transform(
        F.filter(s, lambda x, j: F.coalesce((F.get(s, j - 1)["w"] == x["w"]) | (F.get(s, j + 1)["w"] == x["w"]),
                                            F.get(s, j - 1)["w"] == x["w"], F.get(s, j + 1)["w"] == x["w"], F.lit(False))),
        lambda x: x["i"])))
    at = F.col("__at")
    covered = F.aggregate(F.transform(at, lambda a, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - a, F.lit(3)))),
                          F.lit(0).cast("long"), lambda n, x: n + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__w", "__lines", "__three", "__sorted", "__at")


def transformed(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_dup_lines") - ORDINARY_LINES, F.lit(0))
    repeats = F.greatest(F.col("n_repeat_words") - ORDINARY_REPEATS, F.lit(0))
    return df.withColumns({
        "x_length": F.log1p(F.col("n_words").cast("double")), "x_word": F.log1p(F.col("word_chars") / n),
        "x_symbols": F.log1p(100 * F.col("n_symbols") / n), "x_lines": F.log1p(100 * lines / n),
        "x_repeats": F.log1p(100 * repeats / n)})


def _factor(est: DataFrame) -> DataFrame:
    """Adds i_<a>_<b>, the inverse Cholesky factor of the covariance c_<a>_<b>,
    and logdet."""
    for a in range(P):
        for b in range(a + 1):
            v = F.col(f"c_{a}_{b}")
            for k in range(b):
                v = v - F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}")
            # the floors on the diagonal keep the pivots positive but for rounding
            est = est.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(v, F.lit(1e-9))) if a == b else v / F.col(f"l_{b}_{b}"))
    for b in range(P):
        for a in range(b, P):
            if a == b:
                est = est.withColumn(f"i_{a}_{b}", 1 / F.col(f"l_{a}_{a}"))
            else:
                v = F.lit(0.0)
                for k in range(b, a):
                    v = v - F.col(f"l_{a}_{k}") * F.col(f"i_{k}_{b}")
                est = est.withColumn(f"i_{a}_{b}", v / F.col(f"l_{a}_{a}"))
    logdet = sum((2 * F.log(f"l_{a}_{a}") for a in range(P)), F.lit(0.0))
    return est.select("g", *[f"m_{a}" for a in range(P)],
                      *[f"i_{a}_{b}" for a in range(P) for b in range(a + 1)], logdet.alias("logdet"))


def _distance() -> Column:
    d2 = F.lit(0.0)
    for a in range(P):
        y = sum((F.col(f"i_{a}_{b}") * (F.col(X[b]) - F.col(f"m_{b}")) for b in range(a + 1)), F.lit(0.0))
        d2 = d2 + y * y
    return d2


def _bin(d2: Column) -> Column:
    return F.floor(F.log(F.greatest(d2, F.lit(1e-9))) * BINS)


def _quantile_bin(rows: DataFrame, share: float) -> DataFrame:
    """(g, edge): the least bin up to which a group has ``share`` of its rows."""
    counts = rows.groupBy("g", "bin").agg(F.count("*").alias("n"))
    run = counts.selectExpr("g", "bin", "sum(n) OVER (PARTITION BY g ORDER BY bin) AS below",
                            "sum(n) OVER (PARTITION BY g) AS total")
    return run.where(F.col("below") >= F.ceil(F.lit(share) * F.col("total"))).groupBy("g").agg(F.min("bin").alias("edge"))


def _refit(rows: DataFrame) -> DataFrame:
    # sums around the former centre: small numbers, no loss by cancellation
    d = [F.col(X[a]) - F.col(f"m_{a}") for a in range(P)]
    sums = [F.avg(d[a]).alias(f"s_{a}") for a in range(P)] + [
        F.avg(d[a] * d[b]).alias(f"q_{a}_{b}") for a in range(P) for b in range(a + 1)]
    agg = rows.groupBy("g").agg(*[F.first(f"m_{a}").alias(f"o_{a}") for a in range(P)], *sums)
    floors = list(FLOORS.values())
    return agg.select("g", *[(F.col(f"o_{a}") + F.col(f"s_{a}")).alias(f"m_{a}") for a in range(P)], *[
        (F.col(f"q_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") + (floors[a] ** 2 if a == b else 0.0)).alias(f"c_{a}_{b}")
        for a in range(P) for b in range(a + 1)])


def robust_estimates(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimate of each group ``g``: centre m_a,
    inverse factor i_a_b scaled so that the median distance is the chi-square
    median."""
    floors = list(FLOORS.values())
    start = rows.groupBy("g").agg(*[F.percentile_approx(X[a], 0.5, 10_000).alias(f"m_{a}") for a in range(P)])
    dev = rows.join(start, "g").groupBy("g").agg(*[F.first(f"m_{a}").alias(f"m_{a}") for a in range(P)], *[
        F.percentile_approx(F.abs(F.col(X[a]) - F.col(f"m_{a}")), 0.5, 10_000).alias(f"d_{a}") for a in range(P)])
    est = dev.select("g", *[f"m_{a}" for a in range(P)], *[
        ((F.col(f"d_{a}") * 1.4826) ** 2 + floors[a] ** 2 if a == b else F.lit(0.0)).alias(f"c_{a}_{b}")
        for a in range(P) for b in range(a + 1)])
    est, last = cut(_factor(est)), None
    for _ in range(STEPS):
        at = rows.join(est, "g").withColumn("bin", _bin(_distance()))
        near = at.join(_quantile_bin(at, SUBSET), "g").where("bin <= edge")
        est = cut(_factor(_refit(near)))
        total = est.agg(F.sum("logdet")).first()[0]
        if total is None or (last is not None and abs(total - last) <= SETTLED * max(1.0, abs(total))):
            break
        last = total
    at = rows.join(est, "g").withColumn("bin", _bin(_distance()))
    middle = _quantile_bin(at, 0.5).select("g", (F.exp((F.col("edge") + 1) / BINS) / CHI_MEDIAN).alias("scale"))
    # a scale under one would make tight groups reject more than the floors say
    return cut(est.join(middle, "g").withColumn("scale", F.greatest("scale", F.lit(1.0))))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
            source: str = "source") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance (squared, null where no estimate applies).

    Rows that fail the base rules take no part in the estimates.  A group of
    fewer than LEAST_ROWS rows uses the estimate of its language; where that
    has too few as well, rows that pass the base rules are kept.  Null
    languages and sources are groups of their own; repeated rows are rows."""
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("t"),
                       F.coalesce(F.col(lang).cast("string"), F.lit("\0")).alias("lang"),
                       F.coalesce(F.col(source).cast("string"), F.lit("\0")).alias("source"))
    rows = write_scratch(transformed(statistics(base, "t")), "quality")
    good = rows.where("NOT base_failed")
    sizes = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
    fine = sizes.where(F.col("n") >= LEAST_ROWS).select(
        "lang", "source", F.concat_ws("\1", "lang", "source").alias("g"))
    coarse = (sizes.groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_ROWS)
              .select("lang", F.concat(F.lit("\2"), "lang").alias("g")))
    # which estimate each (lang, source) uses; languages only where needed
    use = cut(sizes.select("lang", "source").join(fine, ["lang", "source"], "left")
              .join(coarse.withColumnRenamed("g", "g2"), "lang", "left")
              .select("lang", "source", F.coalesce("g", "g2").alias("use"), F.col("g").isNull().alias("small"),
                      F.col("g2").alias("whole")))
    langs = use.where("small").select("lang", F.col("whole").alias("g")).where("g is not null").distinct()
    groups = fine.unionByName(langs.join(use.select("lang", "source"), "lang").select("lang", "source", "g"))
    fit_rows = good.select("lang", "source", *X).join(groups, ["lang", "source"]).select("g", *X)
    est = robust_estimates(fit_rows)
    d2 = F.when(F.col("logdet").isNotNull(), _distance() / F.col("scale"))
    judged = (rows.join(use.select("lang", "source", "use"), ["lang", "source"], "left")
              .join(est.withColumnRenamed("g", "use"), "use", "left").withColumn("distance", d2))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CHI_LIMIT, F.lit(True))
    return judged.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
