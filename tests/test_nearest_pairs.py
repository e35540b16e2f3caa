"""Nearest pairs of a block and a chunk: bit for bit those of all distances, with few of these added up."""

import numpy as np
import pytest

from gradeflow.operators import knn


@pytest.mark.parametrize("kind", ["noise", "ties", "far", "infinite"])
@pytest.mark.parametrize("k", [1, 4, 200])
def test_same_as_all_distances(kind, k):
    rng = np.random.default_rng(1)
    q, b = rng.normal(size=(30, 9)), rng.normal(size=(120, 9))
    if kind == "ties":
        q, b = np.round(q), np.round(b[np.arange(120) // 2])
    if kind == "far":  # distances far below the rounding of the squares
        q, b = q * 1e-7 + 1e3, b * 1e-7 + 1e3
    if kind == "infinite":
        b[5, 3] = np.inf
    for limit in (np.full(30, np.inf), np.full(30, np.median(knn.squared(q, b)))):
        d = knn.squared(q, b)
        rows, places = knn.k_least(d, k, limit)
        got = knn.nearest_pairs(q, b, k, limit)
        assert np.array_equal(got[0], rows) and np.array_equal(got[1], places) and np.array_equal(got[2], d[rows, places])


def test_most_distances_are_not_added_up(monkeypatch):
    def never(*_):
        raise AssertionError("all distances")
    monkeypatch.setattr(knn, "squared", never)
    rng = np.random.default_rng(1)
    assert len(knn.nearest_pairs(rng.normal(size=(8, 64)), rng.normal(size=(50, 64)), 3, np.full(8, np.inf))[0]) == 24
