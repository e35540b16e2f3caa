"""Truncated SVD of a rating matrix with a constant fill, by a block Krylov basis.

The matrix is ``A = fill * 1 1' + R`` with R sparse in long form, so it is never formed.  The basis of
the Krylov space of A'A keeps every block (re-orthogonalised, twice where most of a product cancels); a round multiplies
the newest block by R and R' and projects.  Only matrices of basis size reach the driver.

Users and items are dealt to blocks, R lies in packed cells (user block, item block), once dealt by user block and once
by item block; vectors are a numpy matrix per block.  All of them are RDDs with one block a partition, so that cells, products and the
basis meet where they lie: a product moves each vector entry once to each block that needs it, nothing else.
A block of the basis is checkpointed when it is made and never written again.

Since A'A maps all blocks but the newest into the basis, the residual ``|A'A v - s^2 v|`` of a
singular vector follows from the part of the newest product outside the basis, without another pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.arrays import arrays, matrix
from gradeflow.models.blocks import indexed
from gradeflow.session import cut_lineage

GUARD = 18            # columns of a block beyond the wanted rank, on tables of few entries
LARGE = 1 << 20       # entries from which a round costs its vectors, not its jobs: a block has the wanted rank's columns only
CANCELLED = 1e-5      # share of a product's square left outside the basis below which it is orthogonalised twice
EXHAUSTED = 1e-12     # a new direction below this share of the largest squared singular value is rounding
BLOCK_KEYS = 1 << 19  # users (or items) of a block on average, at most
SPREAD = 8            # blocks of a side at least, where each still has ``BLOCK_ENTRIES`` entries
BLOCK_ENTRIES = 1 << 17
NARROW = 0.01         # share of the stop that 32-bit rounding may take
UNPACKED = 10_000     # keys of a batch when blocks are unpacked

CELL = ("keys", "starts", "others", "at", "r")
KINDS = (np.int32, np.int32, np.int32, np.int32, np.float64)


def block_count(entries: int, keys: int) -> int:
    return max(1, math.ceil(keys / BLOCK_KEYS), min(SPREAD, entries // BLOCK_ENTRIES))


def packed(mine: np.ndarray, other: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, ...]:
    """A cell: its keys, where the entries of each start, its distinct others, and of each entry the place among these and the value."""
    order = np.lexsort((other, mine))
    keys, starts = np.unique(mine[order], return_index=True)
    others, at = np.unique(other[order], return_inverse=True)
    return tuple(a.astype(k) for a, k in zip((keys, starts, others, at, r[order]), KINDS))


def turned(cell: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    keys, starts, others, at, r = cell
    return packed(others[at], np.repeat(keys, np.diff(starts, append=len(r))), r)


def cells_of(entries: DataFrame, ub: int, ib: int) -> tuple[RDD, RDD]:
    """(user block, (item block, cell)) and (item block, (user block, turned cell)) of the indexed entries."""
    def run(table: pa.Table) -> pa.Table:
        cell = packed(*(table.column(c).to_numpy() for c in ("ui", "ii", "r")))
        return pa.table([table.column("ub").slice(0, 1), table.column("ib").slice(0, 1), *[pa.array([a.tobytes()]) for a in cell]],
                        names=["ub", "ib", *CELL])
    rows = entries.groupBy("ub", "ib").applyInArrow(run, "ub int, ib int, " + ", ".join(f"{c} binary" for c in CELL)).rdd
    by_user = rows.map(lambda x: (x["ub"], (x["ib"], tuple(np.frombuffer(bytes(x[c]), k) for c, k in zip(CELL, KINDS))))).partitionBy(ub)
    return by_user, by_user.map(lambda x: (x[1][0], (x[0], turned(x[1][1])))).partitionBy(ib)


def sent(vectors: RDD, cells: RDD, to: int, kind) -> RDD:
    """What each block of the other side needs of ``vectors`` (block, matrix): (other block, (block, rows))."""
    def run(rows: Iterator) -> Iterator:
        held = {}
        for block, got in rows:  # the union's first parent comes first
            if isinstance(got, np.ndarray):
                held[block] = got
            else:
                yield got[0], (block, held[block][got[1][0]].astype(kind))
    return vectors.context.union([vectors, cells]).mapPartitions(run).partitionBy(to)


def folded(messages: RDD, cells: RDD, sizes: list[int], width: int) -> RDD:
    """(block, matrix): the cells' entries times what was sent."""
    def run(rows: Iterator) -> Iterator:
        held, out = {}, {}
        for block, (other, got) in rows:
            if isinstance(got, np.ndarray):
                held[block, other] = got
                continue
            keys, starts, _, at, r = got
            total = out.setdefault(block, np.zeros((sizes[block], width)))
            total[keys] += np.add.reduceat(held[block, other].astype(np.float64)[at] * r[:, None], starts, axis=0)
        yield from out.items()
    return messages.context.union([messages, cells]).mapPartitions(run, preservesPartitioning=True)


def blocks_of(df: DataFrame, count: int, width: int) -> RDD:
    """(block, matrix) of rows (block, at, v), one for each place of a block."""
    def run(table: pa.Table) -> pa.Table:
        m = matrix(table.column("v").combine_chunks())[np.argsort(table.column("at").to_numpy())]
        return pa.table([table.column("block").slice(0, 1), pa.array([m.tobytes()])], names=["block", "v"])
    rows = df.select("block", "at", "v").groupBy("block").applyInArrow(run, "block int, v binary").rdd
    return rows.map(lambda x: (x["block"], np.frombuffer(bytes(x["v"])).reshape(-1, width))).partitionBy(count)


def frame_of(blocks: RDD, places: DataFrame, key: str, name: str) -> DataFrame:
    """Key and its row of the blocks; ``places`` has key, block, at."""
    def cut(block: int, m: np.ndarray) -> Iterator:
        for lo in range(0, len(m), UNPACKED):
            yield block, lo, m[lo:lo + UNPACKED].tobytes(), m.shape[1]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lo, data, width in zip(*(b.column(c).to_pylist() for c in ("block", "lo", "v", "width"))):
                m = np.frombuffer(data).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), block, np.int32)), pa.array(np.arange(lo, lo + len(m), dtype=np.int32)),
                                                  arrays(m)], ["block", "at", name])
    spark = places.sparkSession
    rows = spark.createDataFrame(blocks.flatMap(lambda x: cut(*x)), "block int, lo int, v binary, width int")
    return places.join(rows.mapInArrow(unpack, f"block int, at int, {name} array<double>"), ["block", "at"]).select(key, name)


class NotSettled(RuntimeError):
    """The residual stop was not reached."""


class Basis:
    """The basis' blocks and the newest product, all dealt by item block."""

    def __init__(self, totals: RDD):
        self.totals, self.parts = totals, []

    def beside(self, *others: RDD) -> RDD:
        """Per item block: the basis so far, its totals, and the matrices of ``others``."""
        tagged = [p.mapValues(lambda m, j=j: (j, m)) for j, p in enumerate([*self.parts, self.totals, *others])]
        basis = len(self.parts)

        def run(rows: Iterator) -> Iterator:
            held: dict[int, dict] = {}
            for block, (j, m) in rows:
                held.setdefault(block, {})[j] = m
            for block, got in held.items():
                made = [got[j] for j in range(basis, len(got))]
                yield block, (np.hstack([np.zeros((len(made[0]), 0)), *(got[j] for j in range(basis))]), *made)
        return self.totals.context.union(tagged).mapPartitions(run, preservesPartitioning=True)

    def summed(self, part, *others: RDD) -> np.ndarray:
        return self.beside(*others).map(lambda x: part(*x[1])).reduce(lambda a, b: a + b)


def truncated_svd(entries: DataFrame, fill: float, k: int, user: str, item: str, tol: float = 1e-8, max_rounds: int = 60,
                  seed: int = 42, report: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(user factors ``uf``, which hold the singular values, and item factors ``vf``) of the k largest
    singular values of ``fill * 1 1' + R``; ``entries`` are (user, item, _r), one row a pair.

    Ends when ``|A'A v - s^2 v| <= tol * s^2`` for each of the k, or that is below rounding; raises
    ``NotSettled`` otherwise, after ``max_rounds`` blocks of ``k + GUARD`` vectors or as many vectors in narrower blocks.
    ``report`` receives the rounds, values and residuals."""
    entries = cut_lineage(entries)
    size, about_n, about_m, total = entries.agg(F.count(F.lit(1)), F.approx_count_distinct(user), F.approx_count_distinct(item), F.sum("_r")).first()
    ub, ib = block_count(size, about_n), block_count(size, about_m)
    users = cut_lineage(indexed(entries.groupBy(user).agg(F.sum(F.abs("_r")).alias("far")), user, ub))
    items = cut_lineage(indexed(entries.groupBy(item).agg(F.sum(F.abs("_r")).alias("far"), F.sum("_r").alias("total")), item, ib))
    (n, far_u), (m, far_i) = (t.agg(F.count(F.lit(1)), F.max("far")).first() for t in (users, items))
    sizes = []
    for t, count in ((users, ub), (items, ib)):
        found = dict(map(tuple, t.groupBy("block").count().collect()))  # one row per block
        sizes.append([found.get(j, 0) for j in range(count)])
    by_user, by_item = cells_of(
        entries.join(users.select(user, F.col("block").alias("ub"), F.col("at").alias("ui")), user)
               .join(items.select(item, F.col("block").alias("ib"), F.col("at").alias("ii")), item)
               .select("ub", "ib", "ui", "ii", F.col("_r").alias("r")), ub, ib)
    # on large tables products with R travel in 32 bits where their rounding, |R|^2 * 2^-24 at most, is far below the stop
    top = (fill * n * m + total) ** 2 / (n * m)
    kind = np.float32 if size >= LARGE and far_u * far_i * 2.0 ** -24 <= NARROW * EXHAUSTED * top else np.float64
    wide = min(k + GUARD, m)
    b = wide if size < LARGE else min(k, m)
    max_rounds = math.ceil(max_rounds * wide / b)
    bare = Basis(blocks_of(items.select("block", "at", F.array("total").alias("v")), ib, 1))
    basis = Basis(bare.totals)

    def product(last: RDD, width: int, col: np.ndarray, tot: np.ndarray) -> RDD:
        y = folded(sent(last, by_item, ub, kind), by_user, sizes[0], width)
        w = folded(sent(y, by_user, ib, kind), by_item, sizes[1], width)
        # 1'A q = n fill 1'q + (column sums of R)'q
        return bare.beside(w).mapValues(lambda x: x[2] + fill * (x[1] * col + n * fill * col + tot)).persist(StorageLevel.DISK_ONLY)

    def extension(w: RDD, c: np.ndarray, turn: np.ndarray) -> RDD:
        new = basis.beside(w).mapValues(lambda x: (x[2] - x[0] @ c) @ turn)
        new.checkpoint()
        new.count()
        return new
    # the first block: the constant, near which the fill's singular vector lies, and hash draws
    draws = [F.xxhash64(F.lit(seed + j), F.col(item)) / F.lit(float(1 << 63)) for j in range(b - 1)]
    w, q_width, projected = blocks_of(items.select("block", "at", F.array(F.lit(1.0), *draws).alias("v")), ib, b), 0, np.zeros((0, 0))
    col_q, tot_q = np.zeros(0), np.zeros(0)  # per basis column: its sum, and its sum weighted by the items' totals
    for round_ in range(max_rounds + 1):
        got = basis.summed(lambda q, t, x: np.vstack([q.T @ x, x.T @ x, x.sum(0), t.T @ x]), w)
        c, whole, col_w, tot_w = got[:q_width], got[q_width:-2], got[-2], got[-1]
        gram = whole - c.T @ c
        if np.linalg.eigvalsh(gram)[0] < CANCELLED * np.diag(whole).max():
            # most of the product lies in the basis: what is left needs a second orthogonalisation
            def second(q, _, x, c=c):
                p = x - q @ c
                return np.vstack([q.T @ p, p.T @ p])
            got = basis.summed(second, w)
            gram = got[q_width:] - got[:q_width].T @ got[:q_width]
            c = c + got[:q_width]
        if round_:  # the product of the newest block completes a column of the projected matrix
            projected = np.block([[projected, c[:q_width - newest]], [c[:q_width - newest].T, (c[-newest:] + c[-newest:].T) / 2]])
            theta, vectors = np.linalg.eigh(projected)
            theta, vectors = np.maximum(theta[::-1][:k], 0), vectors[:, ::-1][:, :k]
            last = vectors[-newest:]
            residual = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", last, gram, last), 0))
            if report is not None:
                report.update(rounds=round_, values=np.sqrt(theta), residuals=residual)
            if (residual <= np.maximum(tol * theta, EXHAUSTED * theta[0])).all() and len(theta) == min(k, q_width):
                break
            if round_ == max_rounds:
                raise NotSettled(f"residuals {residual} of squared singular values {theta} after {max_rounds} rounds")
        values, turn = np.linalg.eigh(gram)
        scale = projected.max(initial=0.0) if round_ else 0.0
        kept = values > max(EXHAUSTED * max(values.max(), 0.0), (EXHAUSTED * scale) ** 2)
        if not kept.any():
            raise NotSettled("the Krylov space is exhausted before the residuals are small")
        turn = turn[:, kept] / np.sqrt(values[kept])
        newest = int(kept.sum())
        new = extension(w, c, turn)
        w.unpersist()
        basis.parts.append(new)
        col_new, tot_new = (col_w - col_q @ c) @ turn, (tot_w - tot_q @ c) @ turn
        w = product(new, newest, col_new, tot_new)
        q_width += newest
        col_q, tot_q = np.concatenate([col_q, col_new]), np.concatenate([tot_q, tot_new])
    w.unpersist()
    vf = basis.beside().mapValues(lambda x: x[0] @ vectors)
    constant = fill * (col_q @ vectors)
    uf = folded(sent(vf, by_item, ub, np.float64), by_user, sizes[0], vectors.shape[1]).mapValues(lambda y: y + constant)
    return cut_lineage(frame_of(uf, users.select(user, "block", "at"), user, "uf")), cut_lineage(frame_of(vf, items.select(item, "block", "at"), item, "vf"))
