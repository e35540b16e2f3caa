"""The registered factorization machine learns until its loss settles; one pass over the rows solves every real feature."""

import numpy as np
import pytest

from gradeflow.models import fm
from gradeflow.models import ml as ML
from gradeflow.plans import registry

registry.load_all()

from gradeflow.plans import q_models as Q  # noqa: E402


def test_fm_classify_ends_by_its_tolerance(spark, monkeypatch):
    rng, seen, fit = np.random.default_rng(5), {}, fm.fit
    taste, kind = rng.normal(size=(10, 2)), rng.normal(size=(8, 2))
    got = [(u, f"c{i}", u % 3, float((taste[u] * kind[i]).sum() + rng.normal() / 2 > 0), *map(float, rng.normal(size=len(ML.FEATURES))))
           for u in range(10) for i in range(8)]
    rows = spark.createDataFrame(got, ", ".join(["sid long", "cid string", "termnum int", "label double", *(f"{f} double" for f in ML.FEATURES)]))
    monkeypatch.setattr(ML.fm, "fit", lambda *a, **k: fit(*a, **k | {"report": seen}))
    monkeypatch.setattr(Q, "_cls", lambda fx, method: method)
    out = Q.q_fm_cls(None)(rows.where("termnum < 2"), rows.where("termnum = 2"))
    assert out.count() == rows.where("termnum = 2").count()
    loss = seen["loss"]
    assert len(loss) < 100 and loss[-2] - loss[-1] < 1e-3 * loss[-2]
    assert all(b <= a * (1 + 1e-9) for a, b in zip(loss, loss[1:]))  # no sweep raises the loss


@pytest.mark.parametrize("p", [1, 4])
def test_one_pass_solves_the_features_one_after_the_other(p):
    rng, dim, n, ridge = np.random.default_rng(3), 3, 200, 0.7
    u, i, x, real = rng.normal(size=(n, dim + 1)), rng.normal(size=(n, dim + 1)), rng.normal(size=(n, p)), rng.normal(size=(p, dim + 1))
    y = rng.normal(size=n)
    products = fm._products(u, i, x)
    left = y - (fm.predicted(u, i, x, real, 0.3) - products @ fm._weights(real))
    got = fm._solved(real, products.T @ products, products.T @ left, ridge)
    want = real.copy()
    for j in range(p):  # each from the rows themselves
        sums = u[:, 1:] + i[:, 1:] + np.delete(x, j, 1) @ np.delete(want, j, 0)[:, 1:]
        z = x[:, j:j + 1] * np.hstack([np.ones((n, 1)), sums])
        t = y - (fm.predicted(u, i, x, want, 0.3) - z @ want[j])
        want[j] = np.linalg.solve(z.T @ z + ridge * np.eye(dim + 1), z.T @ t)
    assert np.allclose(got, want)
