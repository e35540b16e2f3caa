"""Extremely randomised trees, grown level by level.

Every node of every tree draws some features and, for each, ONE threshold at random between the least and
the largest value its rows have; the draw that lowers the weighted Gini impurity most splits the node.  A
level of all trees takes two aggregates over the rows: the ranges per node and feature, then the class
counts on both sides of the drawn thresholds, added up in numpy per partition and by Spark across.  The driver
holds the trees (a node is a few numbers), never rows; no bootstrap, as the method has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.arrays import matrix


class Forest:
    """Trees as arrays over heap positions (children of node i: 2i + 1 and 2i + 2): the feature that splits a
    node (-1: a leaf), its threshold, and the class weights of its rows."""

    def __init__(self, trees: int, depth: int, classes: int):
        nodes = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature = np.full((trees, nodes), -1, dtype=np.int32)
        self.threshold = np.zeros((trees, nodes))
        self.weights = np.zeros((trees, nodes, classes))

    def nodes_of(self, x: np.ndarray, tree: int, level: int) -> np.ndarray:
        """The node of each row at a level; -1 if the row ended in a leaf above."""
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(level):
            f = self.feature[tree, np.maximum(at, 0)]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.threshold[tree, np.maximum(at, 0)]
            at = np.where((at < 0) | (f < 0), -1, 2 * at + 1 + right)
        return at

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Mean class shares of the leaves that rows reach."""
        total = np.zeros((len(x), self.weights.shape[2]))
        for tree in range(len(self.feature)):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = self.feature[tree, at]
                right = x[np.arange(len(x)), np.maximum(f, 0)] > self.threshold[tree, at]
                at = np.where(f < 0, at, 2 * at + 1 + right)
            w = self.weights[tree, at]
            total += w / np.maximum(w.sum(1, keepdims=True), 1e-300)
        return total / len(self.feature)


def _reduced(rows: DataFrame, part, shape: tuple, how: str) -> np.ndarray:
    """Element-wise sum or least value over all rows of ``part(x, class, weight)``."""
    start = 0.0 if how == "sum" else np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.full(shape, start)
        for b in batches:
            if b.num_rows:
                mine = part(matrix(b.column("x")), b.column("c").to_numpy(), b.column("w").to_numpy())
                total = total + mine if how == "sum" else np.minimum(total, mine)
        flat = total.ravel()
        seen = np.flatnonzero(flat != start)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(flat[seen])], ["i", "v"])
    out = np.full(int(np.prod(shape)), start)
    agg = F.sum("v") if how == "sum" else F.min("v")
    for i, v in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(agg).collect():  # a few numbers a node
        out[i] = v
    return out.reshape(shape)


def gini(w: np.ndarray) -> np.ndarray:
    """Impurity times weight, over the last axis of class weights."""
    total = w.sum(-1)
    return total - (w ** 2).sum(-1) / np.maximum(total, 1e-300)


def grow(rows: DataFrame, n_features: int, classes: int, trees: int = 20, depth: int = 5, draws: int | None = None, seed: int = 42) -> Forest:
    """A forest of ``rows`` (x: array<double>, c: class number, w: weight).  ``draws`` features per node: the square root
    of their number by default."""
    forest, rng = Forest(trees, depth, classes), np.random.default_rng(seed)
    draws = draws or max(1, round(n_features ** 0.5))
    whole = _reduced(rows, lambda x, c, w: np.bincount(c, w, classes), (classes,), "sum")
    forest.weights[:, 0] = whole
    for level in range(depth):
        first, width = 2 ** level - 1, 2 ** level
        open_ = gini(forest.weights[:, first:first + width]) > 1e-12
        if not open_.any():
            break

        def ranges(x, c, w, forest=forest, level=level, first=first, width=width):
            out = np.full((trees, width, 2, n_features), np.inf)
            for t in range(trees):
                at = forest.nodes_of(x, t, level) - first
                for node in np.unique(at[at >= 0]):
                    mine = x[at == node]
                    out[t, node, 0], out[t, node, 1] = mine.min(0), -mine.max(0)
            return out
        got = _reduced(rows, ranges, (trees, width, 2, n_features), "min")
        least, most = got[:, :, 0], -got[:, :, 1]
        # features that vary in the node come first in a random order; one threshold each
        order = np.argsort(np.where(most > least, rng.random(least.shape), 2.0), axis=2)[:, :, :draws]
        lo, hi = (np.take_along_axis(v, order, 2) for v in (least, most))
        valid = (hi > lo) & open_[:, :, None]
        cut = np.where(valid, lo, 0.0) + rng.random(lo.shape) * np.where(valid, hi - np.where(valid, lo, 0.0), 0.0)

        def sides(x, c, w, forest=forest, level=level, first=first, width=width, order=order, cut=cut, valid=valid):
            out = np.zeros((trees, width, draws, 2, classes))
            for t in range(trees):
                at = forest.nodes_of(x, t, level) - first
                rows_ = np.flatnonzero(at >= 0)
                node = at[rows_]
                for d in range(draws):
                    right = x[rows_, order[t, node, d]] > cut[t, node, d]
                    cell = (node * 2 + right) * classes + c[rows_]
                    out[t, :, d] = np.bincount(cell, w[rows_], width * 2 * classes).reshape(width, 2, classes)
            return out
        counts = _reduced(rows, sides, (trees, width, draws, 2, classes), "sum")
        left = np.where(valid & (counts.sum(-1) > 0).all(-1), gini(counts).sum(-1), np.inf)
        best = left.argmin(2)
        for t in range(trees):
            for node in range(width):
                d = best[t, node]
                if np.isfinite(left[t, node, d]):
                    at = first + node
                    forest.feature[t, at], forest.threshold[t, at] = order[t, node, d], cut[t, node, d]
                    forest.weights[t, 2 * at + 1:2 * at + 3] = counts[t, node, d]
    return forest


def predict(rows: DataFrame, forest: Forest, labels: list[float], vector: str = "x") -> DataFrame:
    """Rows with ``prediction``, the label of the largest mean share (ties: the smaller label), and ``shares``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = forest.probabilities(matrix(b.column(vector)))
                shares = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.asarray(labels)[p.argmax(1)]), shares],
                                                 [*b.schema.names, "prediction", "shares"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, prediction double, shares array<double>")
