"""Exact quantiles without a task that holds a column."""

import numpy as np
from pyspark.sql import functions as F

from gradeflow.operators import stats as S


def frame(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 7 == 0 else f"g{i % 3}", 1.0 if i % 3 else float(rng.normal()), None if i % 5 == 0 else float(i % 11))
            for i in range(900)]
    return spark.createDataFrame(rows, "g string, a double, b double").repartition(7), rows


def test_quantiles_of_skewed_columns_and_groups(spark):
    df, rows = frame(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {r["column"]: (r["n"], r["q"]) for r in S.exact_quantiles(df, ["a", "b"], probs).collect()}
    for k, c in ((1, "a"), (2, "b")):
        v = [r[k] for r in rows if r[k] is not None]
        assert got[c][0] == len(v) and np.allclose(got[c][1], np.quantile(v, probs), atol=1e-12)
    by = {(r["g"], r["column"]): r["q"] for r in S.exact_quantiles(df, ["a", "b"], probs, ["g"]).collect()}
    for g in (None, "g0", "g1", "g2"):
        v = [r[1] for r in rows if r[0] == g]
        assert np.allclose(by[g, "a"], np.quantile(v, probs), atol=1e-12)


def test_no_percentile_in_the_plans(spark):
    df, _ = frame(spark)
    for out in (S.describe(df, ["a", "b"]), S.error_quantiles(df, "g", "a"), S.grouped_describe(df, "g", ["a", "b"])):
        assert "percentile" not in out._jdf.queryExecution().toString().lower()


def test_medians_and_empty_columns(spark):
    df, rows = frame(spark)
    df = df.withColumn("none", F.lit(None).cast("double"))
    out, values = S.impute(df, ["b", "none"], "median", all_null="ignore")
    assert values["none"] is None and values["b"] == float(np.median([r[2] for r in rows if r[2] is not None]))
    assert out.where("b IS NULL").count() == 0
    assert S.exact_quantiles(df.limit(0), ["a"], [0.5]).collect() == []
