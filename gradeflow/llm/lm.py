"""Language-model scoring with a hashed maximum-entropy model (operator 6).

log P(word | context) = log P(class | context) + log P(word | class).

*Classes.*  The most frequent tokens are classes of their own; all others share
a class by a hash of their ending.  Inside a shared class a word has its
add-one relative frequency, with one slot for words never seen, so the model is
a distribution over the vocabulary and one unknown word.

*Contexts.*  The class softmax sums weight rows of hashed features: the word
before, the two words before, and the word before that skipped.  Weights start
at zero with class frequencies as bias and are trained by gradient steps on
minibatches in every task; the tasks' steps are averaged per weight row by how
often each saw it.  Round r trains on the rows of the r-th share, so every
training token is used once.

Words are looked up per chunk of texts: a chunk's distinct words are joined
with the corpus counts, so no task needs the whole vocabulary.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import is_held_out, rows, spread, words_of, write_scratch

SINGLE, SHARED = 40, 24          # classes of one token, classes by ending
CLASSES = SINGLE + SHARED
BUCKETS = 1 << 14
FEATURES = 3
ROUNDS = 2
BATCH = 1 << 12                  # tokens in a gradient step
RATE, DAMPING = 0.5, 3.0
CURVE = 0.1                      # curvature a class is given: bounds a step
FLUSH = 200_000
BLOCK = 1024                     # weight rows summed together across tasks
FEW = 8                          # gradients of a weight row up to which rows are added rank by rank
CEILING = 60.0                   # exponents above are cut
END = b""                        # the token after the last word


def ending_class(word: bytes) -> int:
    return SINGLE + zlib.crc32(word[-3:]) % SHARED


def token_counts(docs: DataFrame) -> DataFrame:
    """(w, n) over texts ``t``, ends included; tasks count before the shuffle."""
    def run(batches):
        seen: Counter = Counter()
        for (texts,) in rows(batches, "t"):
            for t in texts:
                seen.update(words_of(t))
                if len(seen) > FLUSH:
                    yield pa.RecordBatch.from_pydict({"w": pa.array([*seen.keys()], pa.binary()), "n": [*seen.values()]})
                    seen.clear()
            seen[END] += len(texts)
        if seen:
            yield pa.RecordBatch.from_pydict({"w": pa.array([*seen.keys()], pa.binary()), "n": [*seen.values()]})

    return docs.select("t").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Corpus totals: bounded by the number of classes."""

    n: int
    v: int
    single: dict[bytes, int]
    class_n: np.ndarray
    class_v: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame) -> Vocabulary:
        top = [(bytes(r["w"]), r["n"]) for r in counts.orderBy(F.desc("n"), "w").limit(SINGLE).collect()]
        single = {w: k for k, (w, _) in enumerate(top)}
        ending = F.lit(SINGLE) + F.crc32(F.substring("w", -3, 3)) % SHARED
        rest = counts.groupBy(F.when(F.length("w") < 3, F.lit(SINGLE) + F.crc32("w") % SHARED).otherwise(ending).alias("c")
                              ).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
        class_n, class_v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for r in rest:
            class_n[r["c"]], class_v[r["c"]] = r["n"], r["v"]
        n, v = int(class_n.sum()), int(class_v.sum())
        for w, k in top:
            class_n[ending_class(w)] -= k
            class_v[ending_class(w)] -= 1
        for k, (_, m) in enumerate(top):
            class_n[k], class_v[k] = m, 1
        return cls(n, v, single, class_n, class_v)

    def class_of(self, word: bytes) -> int:
        k = self.single.get(word)
        return ending_class(word) if k is None else k


def _encode(voc: Vocabulary):
    """(chunk of texts, its words with count, ending class and hash) -> encoded
    texts: sums of the base and the in-class log-probabilities, classes and
    context hashes."""
    shared = np.arange(CLASSES) >= SINGLE

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words = right["w"].to_pylist()
        index = {w: k for k, w in enumerate(words)}
        count = right["n"].to_numpy().astype(np.float64)
        cls = right["ending"].to_numpy().astype(np.int64)
        for w, k in voc.single.items():
            if w in index:
                cls[index[w]] = k
        ctx = right["hash"].to_numpy().astype(np.uint16)
        base = np.log10((count + 1) / (voc.n + voc.v + 1))
        inner = np.where(shared[cls], np.log10((count + 1) / (voc.class_n[cls] + voc.class_v[cls] + 1)), 0.0)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base", "inner", "cls", "ctx")}
        for t in left["t"].to_pylist():
            ws = words_of(t)
            ws.append(END)
            i = np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))
            out["n_tokens"].append(len(ws))
            out["n_known"].append(int((count[i] > 0).sum()))
            out["base"].append(float(base[i].sum()))
            out["inner"].append(float(inner[i].sum()))
            out["cls"].append(cls[i].astype(np.uint8).tobytes())
            out["ctx"].append(ctx[i].tobytes())
        return pa.table({"key": left["key"], "held": left["held"], "chunk": left["chunk"]} | {
            "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()),
            "base": pa.array(out["base"], pa.float64()), "inner": pa.array(out["inner"], pa.float64()),
            "cls": pa.array(out["cls"], pa.binary()), "ctx": pa.array(out["ctx"], pa.binary())})

    return run


# -- the class model -----------------------------------------------------------
def buckets(ctx: list[bytes]) -> np.ndarray:
    """[FEATURES, tokens] weight rows of the contexts in the given texts."""
    parts = [np.frombuffer(c, np.uint16).astype(np.uint64) + np.uint64(1) for c in ctx]
    h = np.concatenate(parts)
    lens = np.array([len(p) for p in parts])
    place = np.arange(len(h)) - np.repeat(np.cumsum(lens) - lens, lens)
    one, two = np.zeros_like(h), np.zeros_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    one[place < 1] = 0
    two[place < 2] = 0
    shift, odd = np.uint64(64 - BUCKETS.bit_length() + 1), np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        return np.stack([(x * odd) >> shift for x in (
            one | np.uint64(1 << 40), one << np.uint64(17) | two | np.uint64(2 << 40),
            two | np.uint64(3 << 40))]).astype(np.int64)


def group_sums(g: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, how often each occurs, sums of its rows of ``g``).  Most keys of a batch occur a few times: their
    first rows are added together, then their second ones; a frequent key's rows are summed by themselves."""
    order = np.argsort(key.astype(np.uint16), kind="stable")  # radix sort
    at = key[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, len(at)))
    total = np.take(g, order[first], axis=0)
    some = np.flatnonzero((count > 1) & (count <= FEW))
    for rank in range(1, FEW):
        some = some[count[some] > rank]
        if not len(some):
            break
        total[some] += np.take(g, order[first[some] + rank], axis=0)
    for k in np.flatnonzero(count > FEW):
        total[k] = np.take(g, order[first[k]:first[k] + count[k]], axis=0).sum(axis=0)
    return at[first], count, total


@dataclass
class Softmax:
    bias: np.ndarray
    weights: np.ndarray
    seen: np.ndarray
    work: np.ndarray | None = None
    bounded: bool | None = None

    @classmethod
    def start(cls, class_n: np.ndarray) -> Softmax:
        p = (class_n + 1.0) / (class_n.sum() + CLASSES)
        return cls(np.log(p).astype(np.float32), np.zeros((BUCKETS, CLASSES), np.float32), np.zeros(BUCKETS, np.float32))

    def exponentials(self, f: np.ndarray, bounded: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """[token, class] and their sums per token; the array is used again by the next call.  ``bounded``: no
        exponent reaches the ceiling."""
        n = f.shape[1]
        if self.work is None or self.work.shape[1] < n:
            self.work = np.empty((2, max(n, BATCH), CLASSES), np.float32)
        z, add = self.work[0, :n], self.work[1, :n]
        np.take(self.weights, f[0], axis=0, out=z, mode="clip")
        for k in range(1, FEATURES):
            z += np.take(self.weights, f[k], axis=0, out=add, mode="clip")
        z += self.bias
        if not bounded:
            np.minimum(z, np.float32(CEILING), out=z)
        np.exp(z, out=z)
        return z, np.einsum("ij->i", z)

    def probabilities(self, f: np.ndarray) -> np.ndarray:
        """[token, class]; the array is used again by the next call."""
        z, total = self.exponentials(f)
        z *= (1 / total)[:, None]
        return z

    def step(self, f: np.ndarray, cls: np.ndarray) -> None:
        """One gradient step, damped by how often a row has been seen."""
        self.bounded = None
        g = self.probabilities(f)
        np.negative(g, out=g)
        g[np.arange(len(cls)), cls] += 1
        for k in range(FEATURES):
            row, count, total = group_sums(g, f[k])
            self.seen[row] += count
            total *= (RATE / (self.seen[row] * CURVE + DAMPING))[:, None]
            self.weights[row] += total

    def log10(self, f: np.ndarray, cls: np.ndarray) -> np.ndarray:
        out = np.empty(len(cls))
        if self.bounded is None:  # scoring leaves the weights as they are
            self.bounded = bool(FEATURES * self.weights.max() + self.bias.max() < CEILING)
        for at in range(0, len(cls), BATCH):
            z, total = self.exponentials(f[:, at:at + BATCH], self.bounded)
            p = z[np.arange(len(z)), cls[at:at + BATCH]] / total
            out[at:at + BATCH] = np.log10(np.maximum(p, 1e-30))
        return out


def _in_batches(batches, *cols):
    """Rows in groups of about BATCH tokens."""
    held: list[tuple] = []
    size = 0
    for lists in rows(batches, "cls", "ctx", *cols):
        for r in zip(*lists):
            held.append(r)
            size += len(r[0])
            if size >= BATCH:
                yield held
                held, size = [], 0
    if held:
        yield held


def _train_round(encoded: DataFrame, model: Softmax) -> Softmax:
    """Gradient steps in every task from the same start, then one mean."""
    def run(batches):
        own = Softmax(model.bias, model.weights.copy(), np.zeros(BUCKETS, np.float32))
        for group in _in_batches(batches):
            f = buckets([g[1] for g in group])
            cls = np.concatenate([np.frombuffer(g[0], np.uint8) for g in group])
            for at in range(0, len(cls), BATCH):
                own.step(f[:, at:at + BATCH], cls[at:at + BATCH])
        if not own.seen.any():
            return
        moved = (own.weights - model.weights) * own.seen[:, None]
        for b in range(0, BUCKETS, BLOCK):
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([b], pa.int32()), "moved": pa.array([moved[b:b + BLOCK].tobytes()], pa.binary()),
                "seen": pa.array([own.seen[b:b + BLOCK].tobytes()], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        moved, seen = np.zeros(BLOCK * CLASSES, np.float64), np.zeros(BLOCK, np.float64)
        for m, s in zip(t["moved"], t["seen"]):
            moved += np.frombuffer(m.as_buffer(), np.float32)
            seen += np.frombuffer(s.as_buffer(), np.float32)
        return pa.table({"block": t["block"][:1], "moved": pa.array([moved.astype(np.float32).tobytes()], pa.binary()),
                         "seen": pa.array([seen.astype(np.float32).tobytes()], pa.binary())})

    schema = "block int, moved binary, seen binary"
    # part sums first: a block never gathers one row from every task at once
    sums = (encoded.mapInArrow(run, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(8)))
            .groupBy("block", "salt").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema).collect())
    out = Softmax(model.bias, model.weights.copy(), model.seen)
    for r in sums:
        b = r["block"]
        seen = np.frombuffer(r["seen"], np.float32)
        out.weights[b:b + BLOCK] += np.frombuffer(r["moved"], np.float32).reshape(BLOCK, CLASSES) / np.maximum(seen, 1)[:, None]
    return out


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts and weights come from rows whose crc32(key) mod 7 is not 2; all
    rows are scored.  Null and empty texts hold the end token alone; null keys
    count as the empty text in the crc32.  With no training rows the counts
    are zero and every token is unknown."""
    src = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn(
        "held", is_held_out(F.col("key"), 7, 2))
    counts = write_scratch(token_counts(src.where("NOT held")), "lm-counts")
    voc = Vocabulary.of(counts)
    n = spread(src)
    chunked = src.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    placed = chunked.repartition(n, "chunk")

    def distinct_words(batches):
        seen: dict[int, set] = {}
        for chunks, texts in rows(batches, "chunk", "t"):
            for c, t in zip(chunks, texts):
                seen.setdefault(c, {END}).update(words_of(t))
        for c, ws in seen.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c] * len(ws), pa.int32()), "w": pa.array([*ws], pa.binary())})

    # all columns go in, so that both uses of the texts share one shuffle
    found = placed.mapInArrow(distinct_words, "chunk int, w binary").join(counts, "w", "left")
    ending = F.when(F.length("w") < 3, F.crc32("w")).otherwise(F.crc32(F.substring("w", -3, 3)))
    known = found.repartition(n, "chunk").select(
        "chunk", "w", F.coalesce("n", F.lit(0)).alias("n"), (F.lit(SINGLE) + ending % SHARED).cast("int").alias("ending"),
        (F.crc32("w") % (1 << 16)).cast("int").alias("hash"))
    kind = src.schema["key"].dataType.simpleString()
    schema = (f"key {kind}, held boolean, chunk int, n_tokens long, n_known long, base double, inner double, "
              "cls binary, ctx binary")
    encoded = write_scratch(placed.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_encode(voc), schema),
                            "lm-encoded")
    model = Softmax.start(voc.class_n)
    for r in range(ROUNDS):
        share = F.pmod(F.xxhash64("cls", "ctx"), F.lit(ROUNDS)) == r
        model = _train_round(encoded.where(~F.col("held") & share).select("cls", "ctx"), model)

    def score(batches):
        for group in _in_batches(batches, "key", "held", "n_tokens", "n_known", "base", "inner"):
            lp = model.log10(buckets([g[1] for g in group]), np.concatenate([np.frombuffer(g[0], np.uint8) for g in group]))
            ends = np.cumsum([len(g[0]) for g in group])
            total = np.add.reduceat(lp, np.concatenate([[0], ends[:-1]]))
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([g[2] for g in group], key_arrow), "held_out": [g[3] for g in group],
                "n_tokens": [g[4] for g in group], "n_known": [g[5] for g in group],
                "train_tokens": pa.array([voc.n] * len(group), pa.int64()), "base_score": [g[6] for g in group],
                "score": pa.array(total + np.array([g[7] for g in group]), pa.float64())})

    from pyspark.sql.pandas.types import to_arrow_type
    key_arrow = to_arrow_type(src.schema["key"].dataType)
    return encoded.mapInArrow(score, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                     "base_score double, score double").withColumnRenamed("key", key)
