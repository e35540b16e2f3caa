"""Rolling searches over linear models from per-term Gram matrices.

One scan adds up, per term, all products of the features, their missing marks and the target.  Prefix sums
over the terms then hold the normal equations of EVERY term's train side, for every window, subset of
features and ridge penalty; missing values take the mean of that train side, which is a linear map of the same
sums.  A second scan takes the errors of all these models at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TERMS = 10_000  # matrices on the driver, coefficients in the tasks: one of each per term


def term_moments(df: DataFrame, features: Sequence[str], target: str, term: str) -> dict[int, np.ndarray]:
    """Per term the Gram matrix of (1, features with 0 for missing, missing marks, target) over rows with a target."""
    z = ["1D", *(f"coalesce(CAST(`{f}` AS DOUBLE), 0D)" for f in features), *(f"IF(`{f}` IS NULL, 1D, 0D)" for f in features),
         f"CAST(`{target}` AS DOUBLE)"]
    cells = [(a, b) for a in range(len(z)) for b in range(a + 1)]
    rows = df.where(F.col(target).isNotNull() & F.col(term).isNotNull()).groupBy(F.col(term).alias("_t")).agg(
        *[F.expr(f"sum({z[a]} * {z[b]}) AS c{i}") for i, (a, b) in enumerate(cells)]).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    out = {}
    for r in rows:
        g = np.zeros((len(z), len(z)))
        for i, (a, b) in enumerate(cells):
            g[a, b] = g[b, a] = r[f"c{i}"]
        out[r["_t"]] = g
    return out


def solve(g: np.ndarray, chosen: Sequence[int], l2: float) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients with the intercept first, means that fill missing values) of the chosen features, from the
    Gram matrix of a train side.  The intercept bears no penalty; a direction without variation gets nothing."""
    p = (len(g) - 2) // 2
    n = g[0, 0]
    known = np.array([n - g[0, 1 + p + j] for j in chosen])
    means = np.divide([g[0, 1 + j] for j in chosen], known, out=np.zeros(len(chosen)), where=known > 0)
    fill = np.zeros((len(chosen) + 1, len(g)))
    fill[0, 0] = 1
    for row, (j, mean) in enumerate(zip(chosen, means), 1):
        fill[row, 1 + j], fill[row, 1 + p + j] = 1, mean
    gram, moment = fill @ g @ fill.T, fill @ g[:, -1]
    # centred, so that the penalty leaves the intercept alone and rounding stays small
    centre = gram[0, 1:] / n
    s = gram[1:, 1:] - n * np.outer(centre, centre) + l2 * np.eye(len(chosen))
    w = np.linalg.pinv(s, rcond=1e-12, hermitian=True) @ (moment[1:] - centre * moment[0]) if len(chosen) else np.zeros(0)
    return np.concatenate([[moment[0] / n - centre @ w], w]), means


def linear_search(df: DataFrame, features: Sequence[str], subsets: Sequence[Sequence[str]] | None = None, l2s: Sequence[float] = (0.0,),
                  windows: Sequence[int | None] = (None,), target: str = "grdpts", term: str = "termnum", bounds=(0.0, 4.0)) -> DataFrame:
    """Rolling RMSE of every (subset of features, ridge penalty, window): for each term a model of the earlier
    terms (the last ``window`` of them), errors as in ``rolling_eval`` (predictions bounded).

    Columns features, l2, window (null: all earlier terms), rmse and n, best first.  Two jobs whatever the number of models
    is.  Rows without target or term are left out; terms without earlier ones are not predicted."""
    features = list(features)
    subsets = [tuple(features)] if subsets is None else [tuple(s) for s in subsets]
    configs = list(itertools.product(subsets, l2s, windows))
    moments = term_moments(df, features, target, term)
    models: dict[int, list] = {}
    for t in moments:
        mine = []
        for window in windows:
            past = [g for v, g in moments.items() if v < t and (window is None or v >= t - window)]
            total = np.sum(past, axis=0) if past else None
            mine.append([(solve(total, [features.index(f) for f in s], l2) if total is not None else None) for s in subsets for l2 in l2s])
        models[t] = [mine[windows.index(w)][subsets.index(s) * len(l2s) + l2s.index(l2)] for s, l2, w in configs]
    chosen = [[features.index(f) for f in s] for s, _, _ in configs]
    size = len(configs)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sse, count = np.zeros(size), np.zeros(size)
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(f"x{j}").to_numpy(zero_copy_only=False) for j in range(len(features))], 1).astype(float)
            y, at = b.column("y").to_numpy(zero_copy_only=False), b.column("t").to_numpy(zero_copy_only=False)
            for t in np.unique(at):
                rows = at == t
                for c, model in enumerate(models[t.item()]):
                    if model is not None:
                        (w, means), xs = model, x[rows][:, chosen[c]]
                        p = w[0] + np.where(np.isnan(xs), means, xs) @ w[1:]
                        e = y[rows] - (np.clip(p, *bounds) if bounds else p)
                        sse[c] += e @ e
                        count[c] += len(e)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(sse), pa.array(count)], ["c", "sse", "n"])
    known = df.where(F.col(target).isNotNull() & F.col(term).isNotNull())
    rows = known.select(F.col(term).cast("long").alias("t"), F.col(target).cast("double").alias("y"),
                        *[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)])
    found = rows.mapInArrow(errors, "c int, sse double, n double").groupBy("c").agg(F.sum("sse"), F.sum("n")).collect()
    out = [(",".join(s), float(l2), w, float(np.sqrt(sse / n)) if n else None, int(n))
           for c, sse, n in found for s, l2, w in [configs[c]]]
    return df.sparkSession.createDataFrame(out, "features string, l2 double, window long, rmse double, n long").orderBy("rmse", "features", "l2")
