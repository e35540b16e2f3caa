"""SimHash near-dedup with vantage-point trees (operator 4).

Equal fingerprints collapse first.  The distinct ones are dealt to shards by
the upper levels of a vantage-point tree: at a node, fingerprints nearer to
the vantage point than the node's radius go left, the others right.  A query
with radius r goes to every child that the triangle bound leaves open, so it
meets each fingerprint within r bits in that one's home shard.  Inside a shard
a smaller tree of the same kind is walked for all queries at once.  A shard
returns a spanning forest of its links, not the pairs; forests are merged by
label propagation over DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import cut, mix64, spread, words_of, write_scratch

SEED = 42
SAMPLE_PER_SHARD = 64  # fingerprints from which the upper levels are laid out
MAX_DEPTH = 13
SHARD_ROWS = 4000      # distinct fingerprints aimed at in a shard
LEAF_ROWS = 48
HASH_BLOCK = 1 << 16   # shingle hashes turned into bit counts at a time


def simhash(text: str | None, words_per_shingle: int = 3) -> int:
    """64-bit fingerprint; bit set where over half the shingles have it."""
    words = words_of(text)
    if not words:
        return 0
    k = words_per_shingle
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), HASH_BLOCK):
        block = h[at:at + HASH_BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str, words_per_shingle: int, out: str = "fp",
                     keep_text: bool = False) -> DataFrame:
    """Appends the fingerprint as a signed long, without the text unless asked
    for; null text counts as no words."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields
                       if keep_text or f.name != text)

    def run(batches):
        for b in batches:
            fps = np.array([simhash(t, words_per_shingle) for t in b.column(text).to_pylist()], np.uint64)
            kept = [i for i, c in enumerate(b.schema.names) if keep_text or c != text]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in kept] + [pa.array(fps.view(np.int64))],
                                             names=[b.schema.names[i] for i in kept] + [out])

    return df.mapInArrow(run, f"{schema}, `{out}` long" if schema else f"`{out}` long")


# -- vantage-point trees -------------------------------------------------------
def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


@dataclass
class Node:
    point: np.uint64 = np.uint64(0)
    radius: int = 0
    left: "Node | int | None" = None
    right: "Node | int | None" = None


def layout(sample: np.ndarray, depth: int, first: int = 0) -> tuple[Node | int, int]:
    """Upper levels from a bounded sample; leaves are shard numbers.

    Of a few candidate points, the one whose distances spread widest; the
    radius splits the sample in half.  A node whose sample can't be split
    becomes a leaf."""
    if depth == 0 or len(sample) < 8:
        return first, first + 1
    tries = sample[np.argsort(mix64(sample))[:8]]
    spread_of = [float(distance(sample, v).std()) for v in tries]
    point = tries[int(np.argmax(spread_of))]
    d = distance(sample, point)
    radius = int(np.median(d))
    inside = d <= radius
    if inside.all():
        radius, inside = radius - 1, d <= radius - 1
    if not inside.any() or inside.all():
        return first, first + 1
    left, n = layout(sample[inside], depth - 1, first)
    right, n = layout(sample[~inside], depth - 1, n)
    return Node(point, radius, left, right), n


def route(tree: Node | int, fps: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) pairs: the home shard with ``slack`` 0, else every shard
    that can hold a fingerprint within ``slack`` bits."""
    out: list[tuple[np.ndarray, int]] = []
    todo = [(tree, np.arange(len(fps)))]
    while todo:
        node, idx = todo.pop()
        if not len(idx):
            continue
        if not isinstance(node, Node):
            out.append((idx, node))
            continue
        d = distance(fps[idx], node.point)
        todo.append((node.left, idx[d - slack <= node.radius]))
        todo.append((node.right, idx[d + slack > node.radius]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return (np.concatenate([i for i, _ in out]),
            np.concatenate([np.full(len(i), s, np.int32) for i, s in out]))


class Forest:
    """Union-find over rows, the smallest member being the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, a: np.ndarray) -> np.ndarray:
        r = self.parent[a]
        while len(r) and (self.parent[r] != r).any():
            r = self.parent[r]
        self.parent[a] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins rows pairwise: only pairs of different trees remain after
        each step, so a dense group costs few steps."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            open_ = low != high
            if not open_.any():
                return
            a, b = low[open_], high[open_]
            np.minimum.at(self.parent, b, a)


def close_pairs(items: np.ndarray, queries: np.ndarray, radius: int):
    """Yields (item rows, query rows) within ``radius`` bits: a vantage-point
    tree over the items is split as the queries walk it."""
    todo = [(np.arange(len(items)), np.arange(len(queries)))]
    while todo:
        a, q = todo.pop()
        if not len(a) or not len(q):
            continue
        if len(a) > LEAF_ROWS:
            x = items[a]
            point = x[int(np.argmin(mix64(x)))]
            d = distance(x, point)
            cutoff = int(np.median(d))
            inside = d <= cutoff
            if inside.all():
                cutoff, inside = cutoff - 1, d < cutoff
            if inside.any():
                dq = distance(queries[q], point)
                todo.append((a[inside], q[dq - radius <= cutoff]))
                todo.append((a[~inside], q[dq + radius > cutoff]))
                continue
        step = max(1, (1 << 20) // len(a))
        for at in range(0, len(q), step):
            part = q[at:at + step]
            i, j = np.nonzero(distance(items[a][:, None], queries[part][None, :]) <= radius)
            if len(i):
                yield a[i], part[j]


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Spanning links (src, dst) over distinct fingerprints (column ``fp``)."""
    spark = fps.sparkSession
    n = fps.count()
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n / SHARD_ROWS))))))
    # a bounded sample only lays the tree out; every fingerprint is dealt
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp")).limit(SAMPLE_PER_SHARD << depth).collect()], np.int64).view(np.uint64)
    tree, _ = layout(sample, depth)

    def deal(batches):
        for b in batches:
            x = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            home = np.empty(len(x), np.int32)
            i, s = route(tree, x, 0)
            home[i] = s
            i, s = route(tree, x, radius)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(s), "fp": pa.array(x[i].view(np.int64)), "home": pa.array(home[i] == s)})

    def match(t: pa.Table) -> pa.Table:
        x = t["fp"].to_numpy().view(np.uint64)
        home = t["home"].to_numpy(zero_copy_only=False)
        order = np.argsort(x)
        x, home = x[order], home[order]
        forest, own = Forest(len(x)), np.flatnonzero(home)
        for i, j in close_pairs(x[own], x, radius):
            forest.join(own[i], j)
        root = forest.roots(np.arange(len(x)))
        linked = root != np.arange(len(x))
        return pa.table({"src": pa.array(x[linked].view(np.int64)), "dst": pa.array(x[root[linked]].view(np.int64))})

    dealt = fps.select("fp").mapInArrow(deal, "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(match, "src long, dst long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links: each round, a node's smallest
    neighbour takes over its larger neighbours, until nothing changes.  Links
    stay as many as nodes at most after the first rounds; every round is cut
    by a checkpoint."""
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
            .distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
                                              .alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        nxt = cut(small)
        same = nxt.count() == e.count() and nxt.exceptAll(e).isEmpty()
        e = nxt
        if same:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3,
                    radius: int = 2) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id: one row per input row.

    component_id is the smallest key reachable over fingerprints that differ
    in ``radius`` bits at most.  Null and empty texts have fingerprint zero and
    are linked like any other.  Null keys are no candidates for the smallest
    key (a component of null keys alone has a null id); keys that repeat keep
    their rows.  An empty table gives an empty result."""
    fps = write_scratch(with_fingerprint(df.select(F.col(key).alias("key"), F.col(text).alias("text")),
                                         "text", words_per_shingle), "simhash-fp")
    return fps.join(_members(fps, radius).select("fp", "component_id"), "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _members(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, low, root, component_id) per distinct fingerprint: its smallest
    key, its component and that one's smallest key."""
    distinct = write_scratch(fps.groupBy("fp").agg(F.min("key").alias("low")), "simhash-distinct")
    comp = components(links(distinct, radius))
    members = distinct.join(comp, distinct["fp"] == comp["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = members.groupBy("root").agg(F.min("low").alias("component_id"))
    return members.join(smallest, "root")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 3,
                radius: int = 2) -> DataFrame:
    """One row of each component, the one with the smallest key (a null key
    only where no other is there; of rows that repeat, one), columns as they are."""
    fps = write_scratch(with_fingerprint(df.select(F.col(key).alias("key"), F.col(text).alias("text")),
                                         "text", words_per_shingle), "simhash-fp")
    pick = _members(fps, radius).groupBy("root").agg(
        F.min(F.struct(F.col("low").isNull().alias("none"), "low", "fp")).alias("p"))
    pick = pick.select(F.col("p.low").alias("__low"), F.col("p.fp").alias("__pick"))
    name = "__fp"
    while name in df.columns:
        name += "_"
    marked = with_fingerprint(df, text, words_per_shingle, name, keep_text=True)
    return (marked.join(pick, F.col(f"`{key}`").eqNullSafe(F.col("__low")) & (F.col(name) == F.col("__pick")), "left_semi")
            .dropDuplicates([key, name]).drop(name))
