"""Models on planted data: they must beat mean-of-means, or the plain answer."""

import warnings
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeflow.models import baselines as B
from gradeflow.models import mf as MF


def planted(spark, n=90, m=40, rank=2, seed=1, share=0.5):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(n, rank)), rng.normal(size=(m, rank))
    y = np.clip(2 + 0.5 * a @ b.T + 0.02 * rng.normal(size=(n, m)), 0, 4)
    rows = [(i, f"c{j:02d}", int(rng.random() < 0.2) * 10, float(y[i, j])) for i in range(n) for j in range(m)
            if rng.random() < share]
    df = spark.createDataFrame(rows, "sid long, cid string, termnum long, grdpts double")
    return df.where("termnum = 0"), df.where("termnum = 10"), y


def rmse(df):
    return df.agg(F.sqrt(F.avg((F.col("pred") - F.col("grdpts")) ** 2))).first()[0]


def test_factorisations_beat_mean_of_means(spark):
    train, test, _ = planted(spark)
    base = rmse(B.mean_of_means(train, test, fallback="global"))
    for method in (MF.mf_als(rank=3, reg=0.05), MF.mf_biased(rank=3, reg=0.05)):
        assert rmse(method(train, test)) < 0.8 * base


def test_gradient_steps_stay_bounded_with_a_popular_item(spark):
    rows = [(u, "hot", 0, 3.0) for u in range(3000)] + [(u, f"c{u % 7}", 0, 2.0) for u in range(300)]
    df = spark.createDataFrame(rows, "sid long, cid string, termnum long, grdpts double")
    out = MF.mf_gd(dim=3, min_iter=2, tol=0.05)(df, df)
    assert all(0 <= r["pred"] <= 4 for r in out.collect())
    # nearer than any constant: the step of the hot item is a mean, not a sum
    assert rmse(out) < df.agg(F.stddev_pop("grdpts")).first()[0]
    with pytest.raises(FloatingPointError):
        MF.mf_gd(dim=2)(df.withColumn("grdpts", F.lit(float("nan"))), df)


def test_svd_is_numpys(spark):
    train, test, _ = planted(spark, n=30, m=14, share=0.6)
    data = {(r["sid"], r["cid"]): r["grdpts"] for r in train.collect()}
    users, items = sorted({k[0] for k in data}), sorted({k[1] for k in data})
    means = {c: np.mean([v for (_, i), v in data.items() if i == c]) for c in items}
    fill = np.mean(list(means.values()))
    full = np.array([[data.get((u, i), fill) for i in items] for u in users])
    u, s, vt = np.linalg.svd(full, full_matrices=False)
    k = 3
    want = (u[:, :k] * s[:k]) @ vt[:k]
    uf, vf, got_fill = MF.svd_factors(train, k)
    assert abs(got_fill - fill) < 1e-9
    uf, vf = ({r[0]: r[1] for r in t.collect()} for t in (uf, vf))
    got = np.array([[np.dot(uf[a], vf[b]) for b in items] for a in users])
    assert np.abs(got - want).max() < 1e-6
    ranks = {(r["sid"], r["cid"], r["k"]): r["pred"] for r in MF.svd_range(1, k)(train, test).collect()}
    for (a, b, r), p in ranks.items():
        if a in users and b in items:
            x = (u[:, :r] * s[:r]) @ vt[:r]
            assert abs(p - min(4, max(0, x[users.index(a), items.index(b)]))) < 1e-6


def svd_frame(spark, full, keep, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, f"c{j:03d}", float(full[i, j])) for i in range(full.shape[0]) for j in range(full.shape[1]) if rng.random() < keep]
    return spark.createDataFrame(rows, "sid long, cid string, grdpts double"), rows


@pytest.mark.parametrize("kind", ["noise", "planted"])
def test_krylov_svd_is_numpys_on_larger_tables(spark, kind):
    """Noise (close singular values) and a planted rank; the residual stop is reached and meant."""
    rng = np.random.default_rng(7)
    n, m, k = 300, 120, 4
    full = np.round(rng.uniform(0, 4, size=(n, m)), 2) if kind == "noise" else \
        2 + rng.normal(size=(n, 3)) @ rng.normal(size=(3, m)) * 0.4 + 0.05 * rng.normal(size=(n, m))
    df, rows = svd_frame(spark, full, 0.25)
    cols = {}
    for _, c, v in rows:
        cols.setdefault(c, []).append(v)
    fill = np.mean([np.mean(v) for v in cols.values()])
    items = sorted(cols)
    users = sorted({r[0] for r in rows})
    a = np.full((len(users), len(items)), fill)
    for i, c, v in rows:
        a[users.index(i), items.index(c)] = v
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    report = {}
    uf, vf, _ = MF.svd_factors(df, k, report=report)
    assert np.abs(report["values"] - s[:k]).max() < 1e-6 * s[0]
    assert (report["residuals"] <= np.maximum(1e-8 * report["values"] ** 2, 1e-12 * s[0] ** 2)).all()
    uf, vf = ({r[0]: r[1] for r in t.collect()} for t in (uf, vf))
    got = np.array([uf[x] for x in users]) @ np.array([vf[c] for c in items]).T
    assert np.abs(got - (u[:, :k] * s[:k]) @ vt[:k]).max() < 1e-6
    with pytest.raises(RuntimeError):
        MF.svd_factors(df, k, max_rounds=2)


def test_svd_edges(spark):
    """One user; equal ratings (rank one); rows without a key or value; a pair rated twice."""
    one = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0)], "sid long, cid string, grdpts double")
    uf, vf, fill = MF.svd_factors(one, 2)
    u, v = uf.first()["uf"], {r["cid"]: r["vf"] for r in vf.collect()}
    assert fill == 2.0 and abs(np.dot(u, v["a"]) - 3) < 1e-9 and abs(np.dot(u, v["b"]) - 1) < 1e-9
    flat = spark.createDataFrame([(i, f"c{j}", 2.0) for i in range(4) for j in range(5)] + [(None, "c1", 4.0), (1, None, 4.0), (2, "c1", None)],
                                 "sid long, cid string, grdpts double")
    uf, vf, fill = MF.svd_factors(flat, 3)
    u, v = ({r[0]: r[1] for r in t.collect()} for t in (uf, vf))
    assert fill == 2.0 and all(abs(np.dot(u[i], v[f"c{j}"]) - 2) < 1e-9 for i in range(4) for j in range(5))
    twice = spark.createDataFrame([(1, "a", 4.0), (1, "a", 2.0), (2, "b", 1.0)], "sid long, cid string, grdpts double")
    uf, vf, fill = MF.svd_factors(twice, 2)
    u, v = ({r[0]: r[1] for r in t.collect()} for t in (uf, vf))
    assert fill == 2.0 and abs(np.dot(u[1], v["a"]) - 3) < 1e-9


def test_nearest_item_is_the_largest_product(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 3)) * rng.uniform(0.1, 3, size=(40, 1))
    df = spark.createDataFrame([(f"c{i:02d}", [float(x) for x in r]) for i, r in enumerate(v)], "cid string, vf array<double>")
    got = dict(map(tuple, MF.nearest_items(df, df).collect()))
    best = (v @ v.T).argmax(axis=1)
    assert got == {f"c{i:02d}": f"c{b:02d}" for i, b in enumerate(best)}


def test_gradient_steps_beat_mean_of_means(spark):
    train, test, _ = planted(spark)
    report = {}
    out = MF.mf_gd(dim=5, reg=0.005, tol=5e-4, report=report)(train, test)
    assert rmse(out) < 0.8 * rmse(B.mean_of_means(train, test, fallback="global"))
    curve = report["rmse"]
    assert all(a >= b for a, b in zip(curve, curve[1:])) and len(curve) < 80


def test_gradient_blocks_and_chunks(spark, monkeypatch):
    """Many blocks and short chunks give the very factors of one block."""
    from gradeflow.models import blocks
    train, test, _ = planted(spark, n=50, m=20)
    one = {(r["sid"], r["cid"]): r["pred"] for r in MF.mf_gd(dim=3, min_iter=4, tol=9.0)(train, test).collect()}
    monkeypatch.setattr(blocks, "BLOCK_KEYS", 6)
    monkeypatch.setattr(blocks, "CHUNK", 7)
    many = {(r["sid"], r["cid"]): r["pred"] for r in MF.mf_gd(dim=3, min_iter=4, tol=9.0)(train, test).collect()}
    assert one.keys() == many.keys() and max(abs(one[k] - many[k]) for k in one) < 1e-9


def test_gradient_cells_grow_with_the_ratings():
    """A cell moves two blocks of factors: their number follows the ratings, not the product of users and items."""
    from gradeflow.models import blocks
    for users, items, ratings in ((15_000, 20_000, 270_000), (900_000, 1_200_000, 16_000_000), (2_000_000, 500, 16_000_000)):
        u, i = blocks.block_counts(ratings, users, items)
        assert u * i <= 4 * ratings / blocks.CHUNK + 4 and users / u <= blocks.BLOCK_KEYS and items / i <= blocks.BLOCK_KEYS
    assert blocks.block_counts(0, 0, 0) == (1, 1)


def engineered(spark, n=400, seed=3):
    from gradeflow.models.ml import FEATURES
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(FEATURES)))
    y = np.clip(2 + 0.6 * x[:, 0] - 0.4 * x[:, 1] + 0.05 * rng.normal(size=n), 0, 4)
    rows = [(i % 20, f"c{i % 7}", 10 * int(i % 4 == 0), float(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "sid long, cid string, termnum long, grdpts double, " + ", ".join(
        f"{f} double" for f in FEATURES))
    return df.where("termnum = 0"), df.where("termnum = 10")


def test_regressions_find_a_planted_line(spark):
    from gradeflow.models import ml as ML
    train, test = engineered(spark)
    constant = test.agg(F.stddev_pop("grdpts")).first()[0]
    for method in (ML.linear(), ML.eps_insensitive(), ML.fm_regress(dim=2, ridge=1.0)):
        assert rmse(method(train, test)) < 0.5 * constant


def test_classifier_leaves_the_estimator_alone(spark):
    from pyspark.ml.classification import LogisticRegression

    from gradeflow.models import ml as ML
    train, test = engineered(spark)
    lab = [d.withColumn("label", (F.col("grdpts") > 2).cast("double")) for d in (train, test)]
    est = LogisticRegression()
    out = ML.classify(est)(*lab)
    assert not est.isSet("weightCol") and not est.isSet("labelCol")
    assert out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.9


def test_registered_svd_settles_on_noise(spark):
    from gradeflow.plans import registry
    registry.load_all()
    from gradeflow.plans import q_models
    rng = np.random.default_rng(4)
    rows = [(u, f"c{i:02d}", 0 if k else 12, float(rng.uniform(0, 4))) for u in range(70)
            for k, i in enumerate(rng.choice(45, 13, replace=False))]
    df = spark.createDataFrame(rows, "sid long, cid string, termnum long, grdpts double")
    data = {(u, c): y for u, c, t, y in rows if not t}
    users, items = sorted({k[0] for k in data}), sorted({k[1] for k in data})
    fill = np.mean([np.mean([v for (_, i), v in data.items() if i == c]) for c in items])
    u, s, vt = np.linalg.svd(np.array([[data.get((a, c), fill) for c in items] for a in users]), full_matrices=False)
    want = (u[:, :5] * s[:5]) @ vt[:5]
    with warnings.catch_warnings():
        warnings.filterwarnings("error", message="singular values")
        got = q_models.q_lookup(SimpleNamespace(ratings=df)).collect()
    assert len(got) == 70
    assert max(abs(r["cell"] - want[users.index(r["sid"]), items.index(r["cid"])]) for r in got) < 1e-4


@pytest.mark.parametrize("repeats", [1, 3])
def test_svd_of_many_blocks_is_numpys(spark, monkeypatch, repeats):
    """Narrow blocks of vectors, many blocks of users and items, each vector block one partition a block; singular values
    that come several times (the same ratings under other keys) come as often."""
    from gradeflow.models import krylov
    rng = np.random.default_rng(5)
    n, m, k = 60, 25, 4
    rows = [(n * r + i, f"c{m * r + j:03d}", float(np.round(v, 2))) for i, j, v in
            ((i, j, rng.uniform(0, 4)) for i in range(n) for j in range(m) if rng.random() < 0.3) for r in range(repeats)]
    df = spark.createDataFrame(rows, "sid long, cid string, grdpts double")
    data = {(u, c): y for u, c, y in rows}
    users, items = sorted({x[0] for x in data}), sorted({x[1] for x in data})
    fill = np.mean([np.mean([v for (_, i), v in data.items() if i == c]) for c in items])
    u, s, vt = np.linalg.svd(np.array([[data.get((a, c), fill) for c in items] for a in users]), full_matrices=False)
    monkeypatch.setattr(krylov, "LARGE", 0)
    monkeypatch.setattr(krylov, "BLOCK_KEYS", 16)
    report, made = {}, []
    init = krylov.Basis.__init__
    monkeypatch.setattr(krylov.Basis, "__init__", lambda self, totals: (init(self, totals), made.append(self))[0])
    uf, vf, _ = MF.svd_factors(df, k, report=report)
    assert np.abs(report["values"] - s[:k]).max() < 1e-6 * s[0]
    basis = made[-1]
    assert len(basis.parts) > 5 and {p.getNumPartitions() for p in basis.parts} == {basis.beside().getNumPartitions()} != {1}
    uf, vf = ({r[0]: r[1] for r in t.collect()} for t in (uf, vf))
    got = np.array([uf[x] for x in users]) @ np.array([vf[c] for c in items]).T
    if repeats == 1:
        assert np.abs(got - (u[:, :k] * s[:k]) @ vt[:k]).max() < 1e-6
    assert np.abs(np.linalg.svd(got, compute_uv=False)[:k] - s[:k]).max() < 1e-6 * s[0]


def test_svd_products_in_32_bits(spark, monkeypatch):
    """Where the stop lies far above their rounding, products travel in 32 bits and the values stay those of 64 bits."""
    from gradeflow.models import krylov
    rng = np.random.default_rng(6)
    rows = [(i, f"c{j:03d}", float(np.round(rng.uniform(0, 4), 2))) for i in range(150) for j in range(60) if rng.random() < 0.1]
    df = spark.createDataFrame(rows, "sid long, cid string, grdpts double")
    kinds, sent, values = [], krylov.sent, []
    monkeypatch.setattr(krylov, "sent", lambda *a: (kinds.append(a[3]), sent(*a))[1])
    monkeypatch.setattr(krylov, "EXHAUSTED", 1e-4)
    monkeypatch.setattr(krylov, "LARGE", 0)
    for share in (0.01, 0.0):
        monkeypatch.setattr(krylov, "NARROW", share)
        report = {}
        MF.svd_factors(df, 3, report=report)
        values.append(report["values"])
    assert {np.float32, np.float64} == set(kinds) and np.abs(values[0] - values[1]).max() < 1e-5 * values[1][0]
