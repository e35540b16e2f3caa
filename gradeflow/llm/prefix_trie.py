"""Prefix trie over rebuilt conversations (operator 13).

A conversation is rebuilt as the head of a base conversation followed by its own
turns behind that head.  No rebuilt text is ever formed: sequences of turns are
elements of a monoid, ``(h1, n1) + (h2, n2) = (h1 * X^n2 + h2, n1 + n2)`` modulo
the prime 2^127 - 1, so the fingerprint of every rebuilt prefix is combined from
the product of the base's head and a running product of the conversation's own
suffix.  One group of equal (depth, fingerprint) is one node.

Equality is verified, not assumed.  Rows refer to turns by a 128-bit id; turns that
share an id are compared by role and text, and all rows of a group must have one
parent group and one last turn.  By induction over the depth a group then holds one
sequence.  A collision of either kind starts the work again under other constants.

Sums over subtrees need no walk level by level: each node is charged to its
representative (smallest member), sums from the end of that member's chain
are taken once per conversation, and what a node's members carry is added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.llm.common import cut

PRIME = (1 << 127) - 1
#: Multipliers tried in turn; a later one is used only after a collision.
MULTIPLIERS = (0x2545F4914F6CDD1D9E3779B97F4A7C15, 0x5851F42D4C957F2D14057B7EF767814F, 0x369DEA0F31A53F85DA942042E4DD58B5)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

PARTS = "conv_id long, kind string, at int, product binary, chars int, a long, b long"
CHAIN = "conv_id long, depth int, node binary, parent binary, chars int, a long, b long, last boolean"


def add_turn(product: int, a: int, b: int, multiplier: int) -> int:
    """The product of a sequence and one more turn with id (a, b)."""
    return (product * multiplier + ((a & 0xFFFFFFFFFFFFFFFF) << 64 | b & 0xFFFFFFFFFFFFFFFF) + 1) % PRIME


def _pack(x: int) -> bytes:
    return x.to_bytes(16, "big")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _flush(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield _batch(rows, schema)
        rows.clear()


def _products(longest_head: int, multiplier: int):
    """Rows of a sorted partition to monoid products: heads ('h': the product of
    the first ``at`` turns), own suffixes ('s': of ``at`` turns behind the head)
    and one row per conversation ('c': ``at`` turns in all)."""
    schema = pa.schema([("conv_id", pa.int64()), ("kind", pa.string()), ("at", pa.int32()), ("product", pa.binary()),
                        ("chars", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, head, suffix, out = None, 0, 0, 0, []
        for batch in batches:
            for c, h, chars, a, b in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "head", "chars", "a", "b"))):
                if c != conv:
                    if conv is not None:
                        out.append((conv, "c", n, None, None, None, None))
                    conv, n, head, suffix = c, 0, 0, 0
                n += 1
                if n <= longest_head:
                    head = add_turn(head, a, b, multiplier)
                    out.append((c, "h", n, _pack(head), chars, a, b))
                if n > h:
                    suffix = add_turn(suffix, a, b, multiplier)
                    out.append((c, "s", n - h, _pack(suffix), chars, a, b))
            yield from _flush(out, schema)
        if conv is not None:
            out.append((conv, "c", n, None, None, None, None))
        yield from _flush(out, schema)
    return run


def _combine(multiplier: int):
    """Suffix rows beside their conversation's head product to nodes of the rebuilt sequence."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()),
                        ("chars", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("last", pa.bool_())])
    inverse = pow(multiplier, -1, PRIME)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, head, k, at, product, chars, a, b, last in zip(*(batch.column(x).to_pylist() for x in (
                    "conv_id", "head_product", "k", "at", "product", "chars", "a", "b", "last"))):
                whole = (int.from_bytes(head, "big") * pow(multiplier, at, PRIME) + int.from_bytes(product, "big")) % PRIME
                before = (whole - add_turn(0, a, b, multiplier)) * inverse % PRIME
                out.append((c, k + at, _pack(whole), _pack(before), chars, a, b, last))
            yield from _flush(out, schema)
    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each node, from rows sorted by node and id; holds one hash state."""
    schema = pa.schema([("depth", pa.int32()), ("node", pa.binary()), ("ends_sha256", pa.string())])
    key, state, out = None, None, []
    for batch in batches:
        for d, node, c in zip(*(batch.column(x).to_pylist() for x in ("depth", "node", "conv_id"))):
            if (d, node) != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (d, node), hashlib.sha256(str(c).encode())
            else:
                state.update(b",%d" % c)
        yield from _flush(out, schema)
    if key:
        out.append((*key, state.hexdigest()))
    yield from _flush(out, schema)


def rebuild_chains(conversations: DataFrame, base: Column, head: Column, longest_head: int, attempt: int = 0) -> DataFrame | None:
    """One row per prefix of every rebuilt conversation: conv_id, depth, node and
    parent fingerprint, code points and id of the last turn, and whether
    the conversation ends there.  ``base`` and ``head`` are expressions of conv_id: the
    conversation whose first ``head`` (0 to ``longest_head``) turns open the rebuilt one.
    None where two different turns share an id."""
    multiplier = MULTIPLIERS[attempt]
    # nothing of the caller's frame but the four columns goes on
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.select("*", F.xxhash64(F.lit(attempt), "role", "text").alias("a"),
                         F.xxhash64(F.lit(~attempt), "text", "role").alias("b"))
    shared = turns.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
    unequal = turns.join(shared, ["a", "b"]).groupBy("a", "b").agg(
        F.min(F.struct("role", "text")).alias("least"), F.max(F.struct("role", "text")).alias("most")).where("least != most")
    if not unequal.isEmpty():
        return None
    ordered = turns.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    parts = cut(ordered.select("conv_id", head.alias("head"), F.char_length("text").alias("chars"), "a", "b")
                .mapInArrow(_products(longest_head, multiplier), PARTS))
    step = F.struct("at", "product", "chars", "a", "b")
    heads = parts.where("kind = 'h'").groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(step)).alias("steps"))  # longest_head rows at most
    convs = parts.where("kind = 'c'").select("conv_id", F.col("at").alias("n"), base.alias("base"), head.cast("int").alias("h"))
    convs = convs.join(heads, "base", "left").withColumn(
        "steps", F.slice(F.coalesce("steps", F.array().cast(heads.schema["steps"].dataType)), 1, F.greatest(F.col("h"), F.lit(0))))
    root = F.lit(_pack(0))
    convs = convs.select("conv_id", "steps", F.size("steps").alias("k"),
                         (F.size("steps") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
                         F.coalesce(F.get("steps", F.size("steps") - 1)["product"], root).alias("head_product"))
    levels = F.concat(
        F.array(F.struct(F.lit(0).alias("depth"), root.alias("node"), F.lit(None).cast("binary").alias("parent"),
                         F.lit(0).alias("chars"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))),
        F.transform("steps", lambda s, i: F.struct(
            s["at"].alias("depth"), s["product"].alias("node"),
            F.coalesce(F.get("steps", i - 1)["product"], root).alias("parent"),
            s["chars"].alias("chars"), s["a"].alias("a"), s["b"].alias("b"))))
    opening = convs.select("conv_id", "length", F.explode(levels).alias("v")).select(
        "conv_id", "v.*", (F.col("v.depth") == F.col("length")).alias("last"))
    rest = parts.where("kind = 's'").drop("kind").join(convs.select("conv_id", "k", "length", "head_product"), "conv_id")
    rest = rest.withColumn("last", F.col("k") + F.col("at") == F.col("length")).mapInArrow(_combine(multiplier), CHAIN)
    return cut(opening.select(*[c.split()[0] for c in CHAIN.split(", ")]).unionByName(rest))


def _nodes(chains: DataFrame) -> DataFrame | None:
    """One row per (depth, node); None if a group's rows differ in parent or last turn."""
    seen = F.struct(F.coalesce("parent", F.lit(b"")).alias("p"), "a", "b", "chars")
    nodes = cut(chains.groupBy("depth", "node").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("parent").alias("parent"),
        F.first("chars").alias("chars"), F.min(seen).alias("least"), F.max(seen).alias("most")))
    return nodes if nodes.where("least != most").isEmpty() else None


def prefix_trie(conversations: DataFrame, base: Column, head: Column, longest_head: int) -> DataFrame:
    """The trie of rebuilt conversations, one row per node: conv_id (smallest member),
    depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens
    (over the subtree: members beyond the first times code points of the last turn),
    ends_sha256 (ids of the members that end here, ascending, comma-joined).

    Rows of a null conv_id belong to no conversation and are left out; a null role or
    text counts as empty; a null turn comes first, rows of equal turns are ordered by
    role and text, so repeated rows are turns of their own.  An absent base
    gives an empty head.  A conversation without rebuilt turns is a member of the root
    only.  An empty table gives no rows; other columns are ignored."""
    for attempt in range(len(MULTIPLIERS)):
        chains = rebuild_chains(conversations, base, head, longest_head, attempt)
        nodes = _nodes(chains) if chains else None
        if nodes:
            break
    else:
        raise ArithmeticError("fingerprints collided under every multiplier")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.drop("least", "most").join(children, ["depth", "node"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    # each node is charged to the chain of its smallest member
    charge = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
                          (F.col("n_children") == 0).cast("long").alias("leaf"))
    onward = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    carried = chains.select("conv_id", "depth", "node").join(charge, ["conv_id", "depth"], "left").select(
        "depth", "node", F.sum(F.coalesce("saved", F.lit(0))).over(onward).alias("saved"),
        F.sum(F.coalesce("leaf", F.lit(0))).over(onward).alias("leaf"))
    subtree = carried.groupBy("depth", "node").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    ends = chains.where("last").select("depth", "node", "conv_id").repartition("depth", "node") \
        .sortWithinPartitions("depth", "node", "conv_id").mapInArrow(_ends, "depth int, node binary, ends_sha256 string")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(subtree, ["depth", "node"]).join(ends, ["depth", "node"], "left").join(parents, ["depth", "parent"], "left")
    return out.select("conv_id", F.col("depth").cast("long"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                      "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def trie_of_conversations(conversations: DataFrame) -> DataFrame:
    """The trie where conversation c opens with crc32(c) % 6 turns of conversation c - c % 100."""
    c = F.col("conv_id").cast("long")
    return prefix_trie(conversations, c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6, 5)
