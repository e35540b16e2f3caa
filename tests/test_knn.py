"""The exact k-nearest join against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeflow.operators import knn as K


def frame(spark, v, name, payload=False):
    rows = [(i, [float(x) for x in r], *([float(i % 5)] if payload else [])) for i, r in enumerate(v)]
    return spark.createDataFrame(rows, f"{name} long, vec array<double>" + (", y double" if payload else ""))


def plain(q, b, k):
    out = set()
    for i, x in enumerate(q):
        d = [(sum((float(s) - float(t)) ** 2 for s, t in zip(x, r)), j) for j, r in enumerate(b)]
        out |= {(i, j, rank + 1) for rank, (_, j) in enumerate(sorted(d)[:k])}
    return out


@pytest.mark.parametrize("kind,k", [("normal", 5), ("grid", 3), ("clusters", 4), ("same", 2), ("line", 1)])
def test_against_all_distances(spark, monkeypatch, kind, k):
    monkeypatch.setattr(K, "CHUNK_ROWS", 16)
    monkeypatch.setattr(K, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(3)
    make = {"normal": lambda n: rng.normal(size=(n, 4)), "grid": lambda n: rng.integers(0, 4, size=(n, 3)),
            "clusters": lambda n: rng.integers(0, 5, size=(n, 1)) * 100 + rng.normal(size=(n, 2)),
            "same": lambda n: np.ones((n, 2)), "line": lambda n: rng.normal(size=(n, 1))}[kind]
    b, q = make(300), make(60)
    report = {}
    got = K.nearest(frame(spark, q, "qid"), frame(spark, b, "bid", True), k, report).collect()
    assert {(r["qid"], r["bid"], r["rank"]) for r in got} == plain(q, b, k)
    assert all(r["y"] == r["bid"] % 5 for r in got)
    assert all(abs(r["distance"] - np.linalg.norm(q[r["qid"]] - b[r["bid"]])) < 1e-9 for r in got)
    assert 0 < report["visited_share"] <= 1
    if kind in ("clusters", "line"):
        assert report["visited_share"] < 0.5


def test_edges(spark):
    none = spark.createDataFrame([], "bid long, vec array<double>")
    q = spark.createDataFrame([(1, [0.0]), (2, None), (None, [1.0])], "qid long, vec array<double>")
    assert K.nearest(q, none, 3).collect() == []
    two = spark.createDataFrame([("a", [0.0]), ("b", [2.0]), ("c", None)], "bid string, vec array<double>")
    assert [(r["qid"], r["bid"]) for r in K.nearest(q, two, 3).orderBy("rank").collect()] == [(1, "a"), (1, "b")]
    assert K.nearest(q.where("qid = 9"), two, 3).collect() == []


def test_largest_products(spark):
    rng = np.random.default_rng(5)
    b, q = rng.normal(size=(200, 6)), rng.normal(size=(40, 6))
    queries, base = K.largest_product(frame(spark, q, "qid"), frame(spark, b, "bid"))
    got = {(r["qid"], r["bid"]) for r in K.nearest(queries, base, 3).collect()}
    want = {(i, int(j)) for i, row in enumerate(q @ b.T) for j in np.argsort(-row)[:3]}
    assert got == want


def test_more_pivots_for_short_vectors(spark):
    """Cells must not grow in proportion to the table."""
    b = spark.range(120_000).select(F.col("id").alias("bid"), F.array(F.col("id") * 1.0).alias("vec"))
    assert len(K.pivots_of(b)) > K.MAX_PIVOTS
    assert len(K.pivots_of(b.select("bid", F.array_repeat(F.col("vec")[0], 200).alias("vec")))) <= K.MAX_PIVOTS


def test_least_of_each_row():
    rng = np.random.default_rng(1)
    for width, k in ((1, 3), (3, 3), (50, 4)):
        d = rng.integers(0, 6, size=(40, width)).astype(float)
        limit = rng.uniform(0, 6, 40)
        q, b = K.k_least(d, k, limit)
        want = [(i, j) for i, row in enumerate(d) for j in np.argsort(row, kind="stable")[:k] if row[j] <= limit[i]]
        assert list(zip(q.tolist(), b.tolist())) == want


def test_equal_train_rows_are_searched_k_times(spark):
    """Many copies of a vector: the k first by key answer for all of them, and no more are searched."""
    from gradeflow.models import ml
    train = spark.createDataFrame([(i, float(i % 3), float(i)) for i in range(600)] + [(None, 0.0, 1.0)], "ord long, a double, y double")
    test = spark.createDataFrame([(0.0,), (0.9,), (0.9,)], "a double")
    got = {(r["vec"][0], r["rank"], r["y"]) for r in ml.neighbours(train, test, 4, ["a"], "y", "ord").collect()}
    assert got == {(0.0, j + 1, 3.0 * j) for j in range(4)} | {(0.9, j + 1, 3.0 * j + 1) for j in range(4)}
