"""Exact k-nearest join by pivots.

Base rows go to the Voronoi cell of their nearest pivot and are packed, by distance from it, into chunks
of bounded length.  What is known of a cell - its count, its least and largest distance and its k
smallest - bounds each query's k-th distance from above; triangle and hyperplane bounds then tell the cells, and
the ring within each, that can hold a nearer row.  Queries of a cell are packed into blocks likewise, blocks
meet the chunks whose rings touch theirs, and each meeting gives its k nearest rows a query; these
are merged per query.  The answer is exact whatever the pivots are: they only decide how much is pruned.

Distances are sums of squared differences in the order of the coordinates, so equal vectors tie exactly; ties go to
the smaller base id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gradeflow.functions.arrays import matrix
from gradeflow.session import cut_lineage

MAX_PIVOTS = 256      # pivots at most where vectors are long
MAX_NUMBERS = 16_384  # coordinates of pivots at most where vectors are short, bounds what is known to every task
CHUNK_ROWS = 2048     # base rows of a chunk at most
BLOCK_QUERIES = 512   # queries of a block at most
LONGEST = 16_384      # base rows that every query is compared with first in a search for the largest product
SLACK = 1e-9          # relative allowance for the rounding of bounds


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two matrices, added up coordinate by coordinate."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        out += d * d
    return out


def _packer(most: int, close):
    """Rows sorted by cell to packed rows of ``most`` rows at most, never across cells; ``close(table)``
    makes one output row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            cells = b.column("cell").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(starts, starts[1:]):
                while lo < hi:
                    if held and (held[-1].column("cell")[0].as_py() != cells[lo] or size >= most):
                        yield close(pa.Table.from_batches(held))
                        held, size = [], 0
                    take = min(hi - lo, most - size)
                    held.append(b.slice(lo, take))
                    size, lo = size + take, lo + take
        if held:
            yield close(pa.Table.from_batches(held))
    return run


def _type_of(df: DataFrame, column: str):
    return df.schema[column].dataType


def pivots_of(base: DataFrame, most: int | None = None) -> np.ndarray:
    """Distinct vectors of the rows with the smallest hashes: about the square root of their number, ``most``
    at most (of short vectors more than of long ones, so that cells stay small when the table grows)."""
    n, width = base.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    most = most or max(MAX_PIVOTS, MAX_NUMBERS // max(width or 1, 1))
    wanted = int(min(most, max(1, n ** 0.5)))
    rows = base.select("vec", F.xxhash64("bid").alias("h")).orderBy("h").limit(wanted).collect()
    return np.unique(np.array([r["vec"] for r in rows], dtype=np.float64), axis=0) if rows else np.zeros((0, 0))


def packed_base(base: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """Chunks (cell, lo, hi, near, ids, ys, vecs): base rows by cell and distance from its pivot; ``near`` are the k least distances."""
    kinds = [f"bid {_type_of(base, 'bid').simpleString()}", f"y {_type_of(base, 'y').simpleString()}"]
    id_type, y_type = (to_arrow_type(_type_of(base, c)) for c in ("bid", "y"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = np.sqrt(squared(matrix(b.column("vec")), pivots))
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell]),
                                                  b.column("bid"), b.column("y"), b.column("vec")], ["cell", "d", "bid", "y", "vec"])
    rows = base.select("bid", "y", "vec").mapInArrow(placed, ", ".join(["cell int", "d double", *kinds, "vec array<double>"]))

    def close(t: pa.Table) -> pa.RecordBatch:
        # by id, so that a smaller place means a smaller id; distances stay beside
        t = t.sort_by("bid")
        d = t.column("d").to_numpy()
        return pa.RecordBatch.from_pylist([{
            "cell": t.column("cell")[0].as_py(), "lo": float(d.min()), "hi": float(d.max()), "near": np.sort(d)[:k].tolist(),
            "ids": t.column("bid").to_pylist(), "ys": t.column("y").to_pylist(),
            "vecs": matrix(t.column("vec").combine_chunks()).ravel()}], schema=pa.schema([
                ("cell", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("near", pa.list_(pa.float64())),
                ("ids", pa.list_(id_type)), ("ys", pa.list_(y_type)), ("vecs", pa.list_(pa.float64()))]))
    ordered = rows.repartitionByRange("cell", "d", "bid").sortWithinPartitions("cell", "d", "bid")
    schema = (f"cell int, lo double, hi double, near array<double>, ids array<{kinds[0][4:]}>, ys array<{kinds[1][2:]}>, "
              "vecs array<double>")
    return cut_lineage(ordered.mapInArrow(_packer(CHUNK_ROWS, close), schema))


def visits(queries: DataFrame, pivots: np.ndarray, cells: dict[int, tuple[float, float, list[float]]], k: int) -> DataFrame:
    """(cell, d, reach, qid, vec): the cells a query must visit, its distance from the pivot and its bound."""
    kind = _type_of(queries, "qid").simpleString()
    cid = np.array(sorted(cells), dtype=np.int64)
    lo, hi = (np.array([cells[c][i] for c in cid]) for i in (0, 1))
    near = np.full((len(cid), k), np.inf)
    for row, c in enumerate(cid):
        d = sorted(cells[c][2])[:k]
        near[row, :len(d)] = d
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_QUERIES):
                b = whole.slice(at, BLOCK_QUERIES)
                d = np.sqrt(squared(matrix(b.column("vec")), pivots))
                mine, dc = d.argmin(1), d[:, cid]
                above = (dc[:, :, None] + near[None]).reshape(len(d), -1)
                reach = np.partition(above, k - 1, axis=1)[:, k - 1] if above.shape[1] > k - 1 else np.full(len(d), np.inf)
                reach = reach * (1 + SLACK) + SLACK * (1 + d.max(1))
                least = np.maximum(dc - hi, lo - dc)  # rings
                gap = np.sqrt(squared(pivots[mine], pivots[cid]))
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (dc ** 2 - d[np.arange(len(d)), mine][:, None] ** 2) / (2 * gap)
                least = np.where(gap > 0, np.maximum(least, plane), least)
                q, c = np.nonzero(least <= reach[:, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[c].astype(np.int32)), pa.array(dc[q, c]), pa.array(reach[q]), b.column("qid").take(pa.array(q)),
                     b.column("vec").take(pa.array(q))], ["cell", "d", "reach", "qid", "vec"])
    return queries.select("qid", "vec").mapInArrow(run, f"cell int, d double, reach double, qid {kind}, vec array<double>")


def k_least(d: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the k least values of each row that don't exceed its limit, ties by the smaller place."""
    if d.shape[1] > k:
        limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
    q, b = np.nonzero(d <= limit[:, None])  # a few a row, but for ties
    order = np.lexsort((b, d[q, b], q))
    q, b = q[order], b[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], b[rank < k]


def nearest_pairs(queries: np.ndarray, base: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, squared distance) of the k nearest base rows of each query within its limit, ties by the smaller place.
    A matrix product gives all distances but for their rounding; only pairs that may be among the k are added up."""
    own, other = (queries ** 2).sum(1), (base ** 2).sum(1)
    with np.errstate(invalid="ignore"):
        about = own[:, None] + other - 2 * (queries @ base.T)
    if not np.isfinite(about).all():
        d = squared(queries, base)
        q, b = k_least(d, k, limit)
        return q, b, d[q, b]
    rounding = 1e-3 * SLACK * (own + other.max())  # far more than that of either sum
    at_most = limit + rounding
    if about.shape[1] > k:
        at_most = np.minimum(at_most, np.partition(about, k - 1, axis=1)[:, k - 1] + 2 * rounding)
    q, b = np.nonzero(about <= at_most[:, None])  # a few a row, but for ties
    d = np.zeros(len(q))
    for j in range(queries.shape[1]):
        step = queries[q, j] - base[b, j]
        d += step * step
    kept = d <= limit[q]
    q, b, d = q[kept], b[kept], d[kept]
    order = np.lexsort((b, d, q))
    q, b, d = q[order], b[order], d[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], b[rank < k], d[rank < k]


def _meet(k: int, qid_type: pa.DataType, bid_type: pa.DataType, y_type: pa.DataType):
    """A block of queries and a chunk to each query's k nearest rows of the chunk within reach."""
    schema = pa.schema([("qid", qid_type), ("bid", bid_type), ("y", y_type), ("d2", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {c: batch.column(c)[row].values for c in ("qids", "qvecs", "reach", "ids", "ys", "vecs")}
                reach = cell["reach"].to_numpy()
                queries = cell["qvecs"].to_numpy().reshape(len(reach), -1)
                base = cell["vecs"].to_numpy().reshape(len(cell["ids"]), -1)
                q, b, d = nearest_pairs(queries, base, k, (reach * (1 + SLACK)) ** 2)
                if not len(q):
                    continue
                yield pa.RecordBatch.from_arrays([cell["qids"].take(pa.array(q)), cell["ids"].take(pa.array(b)),
                                                  cell["ys"].take(pa.array(b)), pa.array(d)], schema=schema)
    return run


def nearest(queries: DataFrame, base: DataFrame, k: int, report: dict | None = None) -> DataFrame:
    """(qid, bid, y, distance, rank): the k nearest base rows of each query, by (distance, bid).

    ``queries`` are (qid, vec), ``base`` (bid, vec) and optionally a payload ``y``; vectors are array<double> of one length,
    qid and bid are unique and simple (not nested) in ``base``.  Rows with a null id or vector
    find nothing and are not found.  With fewer than k base rows all of them are returned, without any, nothing.
    ``report`` receives the number of cells and the share of (query, cell) pairs that are visited."""
    queries = queries.where("qid IS NOT NULL AND vec IS NOT NULL").select("qid", F.col("vec").cast("array<double>").alias("vec"))
    if "y" not in base.columns:
        base = base.withColumn("y", F.lit(None).cast("double"))
    base = base.where("bid IS NOT NULL AND vec IS NOT NULL").select("bid", "y", F.col("vec").cast("array<double>").alias("vec"))
    pivots = pivots_of(base)
    qid, bid, y = _type_of(queries, "qid"), _type_of(base, "bid"), _type_of(base, "y")
    if not len(pivots):
        return queries.sparkSession.createDataFrame([], f"qid {qid.simpleString()}, bid {bid.simpleString()}, y {y.simpleString()}, "
                                                        "distance double, rank int")
    chunks = packed_base(base, pivots, k)
    known = chunks.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    few = chunks.select("cell", F.explode("near").alias("d"))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).where(F.col("r") <= k)
    # bounded: k rows a pivot
    few = few.groupBy("cell").agg(F.collect_list("d").alias("near"))
    cells = {r["cell"]: (r["lo"], r["hi"], r["near"]) for r in known.join(few, "cell").collect()}
    pairs = visits(queries, pivots, cells, k)
    qid_type, bid_type, y_type = map(to_arrow_type, (qid, bid, y))

    def close(t: pa.Table) -> pa.RecordBatch:
        d, reach = t.column("d").to_numpy(), t.column("reach").to_numpy()
        return pa.RecordBatch.from_pylist([{
            "cell": t.column("cell")[0].as_py(), "qlo": float((d - reach).min()), "qhi": float((d + reach).max()),
            "qids": t.column("qid").to_pylist(), "reach": reach,
            "qvecs": matrix(t.column("vec").combine_chunks()).ravel()}], schema=pa.schema([
                ("cell", pa.int32()), ("qlo", pa.float64()), ("qhi", pa.float64()), ("qids", pa.list_(qid_type)),
                ("reach", pa.list_(pa.float64())), ("qvecs", pa.list_(pa.float64()))]))
    blocks = pairs.repartitionByRange("cell", "d", "qid").sortWithinPartitions("cell", "d").mapInArrow(
        _packer(BLOCK_QUERIES, close),
        f"cell int, qlo double, qhi double, qids array<{qid.simpleString()}>, reach array<double>, qvecs array<double>")
    blocks = cut_lineage(blocks)
    if report is not None:
        n = queries.count()
        seen = blocks.agg(F.sum(F.size("qids"))).first()[0] or 0
        report.update(cells=len(cells), visited_share=seen / (n * len(cells)) if n else 0.0)
    meet = blocks.join(chunks.drop("near"), (blocks["cell"] == chunks["cell"]) & (F.col("lo") <= F.col("qhi")) & (F.col("hi") >= F.col("qlo")))
    found = meet.select("qids", "qvecs", "reach", "ids", "ys", "vecs").mapInArrow(
        _meet(k, qid_type, bid_type, y_type), f"qid {qid.simpleString()}, bid {bid.simpleString()}, y {y.simpleString()}, d2 double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("d2", "bid"))  # k rows a meeting at most; the rank limit is pushed down
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "qid", "bid", "y", F.sqrt("d2").alias("distance"), "rank")


def largest_product(queries: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and base such that the nearest base rows are those of the largest dot products: with
    one coordinate more, ``sqrt(M^2 - |b|^2)`` for base rows and 0 for queries, all base rows have the norm M."""
    def norm2(c):
        return F.aggregate(F.transform(c, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x)
    longest = base.agg(F.max(norm2(F.col("vec")))).first()[0] or 0.0
    extra = F.sqrt(F.greatest(F.lit(longest) - norm2(F.col("vec")), F.lit(0.0)))
    return (queries.withColumn("vec", F.concat("vec", F.array(F.lit(0.0)))),
            base.withColumn("vec", F.concat("vec", F.array(extra))))


def _norm(c: str):
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x))


def largest(queries: DataFrame, base: DataFrame, report: dict | None = None) -> DataFrame:
    """(qid, bid): the base row of the largest dot product with each query, ties to the smaller bid.

    Exact.  Products are compared as the distances of ``largest_product``.  Every query meets the ``LONGEST`` base rows of the
    largest norm where it lies; no other row's product exceeds the norms' product, which settles most queries.  The
    others are packed into blocks by the least norm that could still win, the other base rows into chunks by norm, and a block
    meets the chunks that reach its norm; queries move once.  Arguments as for ``nearest``; ``report`` receives the
    number of queries that are not settled at first."""
    queries, base = largest_product(*(d.where(f"{key} IS NOT NULL AND vec IS NOT NULL").select(key, F.col("vec").cast("array<double>").alias("vec"))
                                      for d, key in ((queries, "qid"), (base, "bid"))))
    qid, bid = _type_of(queries, "qid"), _type_of(base, "bid")
    base = cut_lineage(base.select("bid", "vec", _norm(F.slice("vec", F.lit(1), F.size("vec") - 1)).alias("norm")))
    first = base.orderBy(F.desc("norm"), "bid").limit(LONGEST + 1).collect()  # these rows
    if not first:
        return queries.sparkSession.createDataFrame([], f"qid {qid.simpleString()}, bid {bid.simpleString()}")
    all_met = len(first) <= LONGEST
    least = first[-1]["norm"]  # the largest norm of the others
    first = first[:LONGEST]
    first.sort(key=lambda r: r["bid"])  # so that a smaller place means a smaller id
    ids, vecs = pa.array([r["bid"] for r in first], to_arrow_type(bid)), np.array([r["vec"] for r in first])
    widest = float((vecs ** 2).sum(1).max())  # of every base row, but for rounding

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_QUERIES):
                b = whole.slice(at, BLOCK_QUERIES)
                q = matrix(b.column("vec"))
                d2 = squared(q, vecs)
                best = d2.argmin(1)
                d2 = d2[np.arange(len(q)), best]
                own = (q ** 2).sum(1)
                # a base row of a smaller norm than this is farther away
                with np.errstate(divide="ignore", invalid="ignore"):
                    norm = (widest + own - d2 - 1e-3 * SLACK * (widest + own)) / (2 * np.sqrt(own))
                yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("vec"), ids.take(pa.array(best)), pa.array(d2),
                                                  pa.array(np.where(own > 0, norm, 0.0))], ["qid", "vec", "bid", "d2", "norm"])
    met = cut_lineage(queries.mapInArrow(settled, f"qid {qid.simpleString()}, vec array<double>, bid {bid.simpleString()}, d2 double, norm double"))
    open_ = met.where(F.lit(not all_met) & (F.col("norm") <= F.lit(least)))
    left = open_.count()
    if report is not None:
        report.update(open=left)
    found = met.select("qid", "d2", "bid")
    if left:
        qid_type, bid_type, y_type = to_arrow_type(qid), to_arrow_type(bid), pa.float64()

        def block(t: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{
                "least": t.column("norm").to_numpy().min(), "qids": t.column("qid").to_pylist(), "reach": np.sqrt(t.column("d2").to_numpy()),
                "qvecs": matrix(t.column("vec").combine_chunks()).ravel()}], schema=pa.schema([
                    ("least", pa.float64()), ("qids", pa.list_(qid_type)), ("reach", pa.list_(pa.float64())), ("qvecs", pa.list_(pa.float64()))]))

        def chunk(t: pa.Table) -> pa.RecordBatch:
            t = t.sort_by("bid")
            return pa.RecordBatch.from_pylist([{
                "most": t.column("norm").to_numpy().max(), "ids": t.column("bid").to_pylist(), "ys": [None] * len(t),
                "vecs": matrix(t.column("vec").combine_chunks()).ravel()}], schema=pa.schema([
                    ("most", pa.float64()), ("ids", pa.list_(bid_type)), ("ys", pa.list_(y_type)), ("vecs", pa.list_(pa.float64()))]))

        def packed(rows, key, most, close, schema):
            ordered = rows.withColumn("cell", F.lit(0)).repartitionByRange("norm", key).sortWithinPartitions("norm")
            return cut_lineage(ordered.mapInArrow(_packer(most, close), schema))
        blocks = packed(open_, "qid", BLOCK_QUERIES, block, f"least double, qids array<{qid.simpleString()}>, reach array<double>, qvecs array<double>")
        chunks = packed(base.where(F.col("norm") <= F.lit(least)), "bid", CHUNK_ROWS, chunk,
                        f"most double, ids array<{bid.simpleString()}>, ys array<double>, vecs array<double>")
        meet = blocks.join(chunks, F.col("most") >= F.col("least"))
        nearer = meet.select("qids", "qvecs", "reach", "ids", "ys", "vecs").mapInArrow(
            _meet(1, qid_type, bid_type, y_type), f"qid {qid.simpleString()}, bid {bid.simpleString()}, y double, d2 double")
        found = found.unionByName(nearer.select("qid", "d2", "bid"))
    best = found.groupBy("qid").agg(F.min(F.struct("d2", "bid")).alias("best")) if left else found.withColumn("best", F.struct("d2", "bid"))
    return best.select("qid", F.col("best.bid").alias("bid"))
