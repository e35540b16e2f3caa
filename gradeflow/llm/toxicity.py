"""Toxic passages by maximum-scoring segments (operator 8).

*Learning.*  Token counts of toxic and clean training texts give log-odds with
an informative Dirichlet prior (prior mass in proportion to the corpus
frequency).  Tokens whose z-score passes ``Z`` are candidates.  They are counted
again by document, where a (word before, word, word after) context counts for
one document only: copies of a text, and a text that repeats its words, count
once.  Those that still pass, with odds of ``MIN_ODDS`` at least, form the
lexicon; a token scores its log-odds less one standard error, so that rare
ones say less.  Its later occurrences in a text score the log-odds of its
occurrences, less one standard error, where these are lower: a word that clean
texts repeat says less each time.  All other tokens share one value, slightly
negative.

*Scoring.*  A linear scan finds every maximal scoring segment of a text; every
occurrence of a token scores.
Chance segments of clean text follow an extreme-value law: E(S) = K n
exp(-lambda S); lambda comes from the clean token distribution, or from the
segments of clean training texts where repeats make these longer than single
draws would, K from their number.  The evidence of a text is minus the log of
the E-value of its best segment, mapped to a probability by a logistic curve
fitted to the binned evidence of all training texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gradeflow.llm.bpe import BoundedCache
from gradeflow.llm.common import is_held_out, rows, words_of

Z = 1.5
MIN_ODDS = math.log(4)
PRIOR_SHARE = 0.001     # Dirichlet prior mass as a share of all training tokens
PRIOR_LEAST = 0.05      # and at least, for a token
LEXICON = 50_000        # tokens kept at most, by z: bounds the broadcast model
BROADCAST_ROWS = 1_000_000
FLUSH = 200_000
BIN = 0.25              # evidence bins of the calibration
THRESHOLD = 0.7
_EDGE = b".,;:!?#*$%&|<>\"'()[]{}-_=+/\\~`^@"


def token(word: bytes) -> bytes:
    return word.strip(_EDGE) or word


@dataclass
class Model:
    scores: dict[bytes, float] = field(default_factory=dict)
    other: float = -0.01
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    bias: float = -20.0
    #: what an occurrence after the first scores; without an entry, like other tokens
    repeats: dict[bytes, float] = field(default_factory=dict)

    def evidence(self, best: float, n: int) -> float:
        """-ln E of the best segment; none, or one expected by chance, is zero."""
        return max(0.0, self.lam * best - math.log(self.k * max(n, 1))) if best > 0 else 0.0

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, self.bias + self.slope * evidence))))


def segments(at: np.ndarray, score: np.ndarray, n: int, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, past the last word, score).

    ``at``/``score`` give the words with a score of their own; the others score
    ``other`` (negative), so gaps are added up instead of walked.  The stack
    holds candidates with the running total before (l) and after (r) each."""
    stack: list[tuple[int, int, float, float]] = []
    total, last = 0.0, 0
    for i, s in zip(at.tolist(), score.tolist()):
        total += other * (i - last)
        last = i + 1
        before, total = total, total + s
        if s <= 0:
            continue
        first, low = i, before
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] > low:  # of segments that score the same the leftmost counts
                j -= 1
            if j < 0 or stack[j][3] >= total:
                stack.append((first, i + 1, low, total))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - lo) for a, b, lo, r in stack]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        get = model.scores.get
        self.of = BoundedCache(lambda w: get(token(w), model.other))

    def __call__(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = words_of(text)
        s = np.fromiter(map(self.of.__getitem__, words), np.float64, len(words))
        at = np.flatnonzero(s != self.model.other)
        seen: set[bytes] = set()
        for i in at.tolist():
            w = token(words[i])
            if w in seen:
                s[i] = self.model.repeats.get(w, self.model.other)
            seen.add(w)
        return len(words), segments(at, s[at], len(words), self.model.other)


# -- learning ------------------------------------------------------------------
def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """Training rows (t, y).  Null labels and null keys teach nothing; of labels that
    repeat for a key the larger counts."""
    y = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~is_held_out(F.col(key), 3, 1))
         .groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y")))
    if y.count() <= BROADCAST_ROWS:  # 12 bytes a row; larger tables are joined by key
        y = F.broadcast(y)
    return (docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
            .join(y, "k").select("k", "t", "y"))


def _token_counts(train: DataFrame) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            keys = list(seen[0].keys() | seen[1].keys())
            b = pa.RecordBatch.from_pydict({"w": pa.array(keys, pa.binary()), "y0": [seen[0][k] for k in keys],
                                            "y1": [seen[1][k] for k in keys]})
            seen[0].clear()
            seen[1].clear()
            return b

        of = BoundedCache(token)
        for texts, ys in rows(batches, "t", "y"):
            for t, y in zip(texts, ys):
                seen[1 if y == 1 else 0].update(map(of.__getitem__, words_of(t)))
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield out()
        if seen[0] or seen[1]:
            yield out()

    return (train.mapInArrow(run, "w binary, y0 long, y1 long").groupBy("w")
            .agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1")))


def _document_counts(train: DataFrame, words: set[bytes]) -> DataFrame:
    """Documents of each class that use the given tokens in a context of their
    own: a context that recurs belongs to the smallest document."""
    def run(batches):
        of = BoundedCache(token)
        for keys, texts, ys in rows(batches, "k", "t", "y"):
            found = {}
            for k, t, y in zip(keys, texts, ys):
                ws = [of[w] for w in words_of(t)]
                for i, w in enumerate(ws):
                    if w in words:
                        found.setdefault((w, b" ".join(ws[max(0, i - 1):i + 2]), 1 if y == 1 else 0), k)
            yield pa.RecordBatch.from_pydict({
                "w": pa.array([f[0] for f in found], pa.binary()), "c": pa.array([f[1] for f in found], pa.binary()),
                "y": pa.array([f[2] for f in found], pa.int32()), "k": pa.array([*found.values()], key_arrow)})

    kind = train.schema["k"].dataType  # keys of any type: they only tell documents apart
    key_arrow = to_arrow_type(kind)
    return (train.select("k", "t", "y")
            .mapInArrow(run, f"w binary, c binary, y int, k {kind.simpleString()}")
            .groupBy("w", "c", "y").agg(F.min("k").alias("k")).select("w", "y", "k").distinct().groupBy("w")
            .agg(F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("y0"), F.sum("y").alias("y1")))


def log_odds(y0: float, y1: float, n0: float, n1: float, a: float, a0: float) -> tuple[float, float]:
    """Log-odds and z-score under a Dirichlet prior of mass ``a`` for the token."""
    d = math.log((y1 + a) / (n1 + a0 - y1 - a)) - math.log((y0 + a) / (n0 + a0 - y0 - a))
    return d, d / math.sqrt(1 / (y1 + a) + 1 / (y0 + a))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Model:
    """Fit lexicon, extreme-value law and calibration on all training rows.

    Rows whose crc32(key) mod 3 is 1 are held out and never read here.  With
    no training rows of both classes the model scores every text near zero."""
    train = _labelled(docs, labels, key, text, label)
    counts = _token_counts(train)
    n0, n1 = (float(x or 0) for x in counts.agg(F.sum("y0"), F.sum("y1")).first())
    if not n0 or not n1:
        return Model()
    a0 = PRIOR_SHARE * (n0 + n1)
    a = F.greatest(F.lit(PRIOR_SHARE) * (F.col("y0") + F.col("y1")), F.lit(PRIOR_LEAST))
    d = F.log((F.col("y1") + a) / (n1 + a0 - F.col("y1") - a)) - F.log((F.col("y0") + a) / (n0 + a0 - F.col("y0") - a))
    z = d / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))
    picked = (counts.select("w", "y0", "y1", z.alias("z")).where((F.col("z") >= Z) & (d >= MIN_ODDS))
              .orderBy(F.desc("z"), "w").limit(LEXICON).collect())
    first = {bytes(r["w"]): (r["y0"], r["y1"]) for r in picked}
    again = {bytes(r["w"]): (r["y0"], r["y1"]) for r in _document_counts(train, set(first)).collect()} if first else {}
    docs0, docs1 = (float(x or 0) for x in train.agg(F.sum(1 - F.col("y")), F.sum("y")).first())
    scores, repeats, m0, m1 = {}, {}, 0.0, 0.0
    for w, (y0, y1) in first.items():
        c0, c1 = again.get(w, (0, 0))
        s, z_ = log_odds(c0, c1, docs0 + 1, docs1 + 1, PRIOR_SHARE * (c0 + c1) + PRIOR_LEAST, PRIOR_SHARE * (docs0 + docs1))
        if z_ >= Z and s >= MIN_ODDS:
            scores[w] = s - s / z_
            d_, dz = log_odds(y0, y1, n0, n1, max(PRIOR_SHARE * (y0 + y1), PRIOR_LEAST), a0)
            repeats[w] = min(scores[w], d_ - d_ / dz)
            m0, m1 = m0 + y0, m1 + y1
    # what is left shares one value: its odds, and a small charge per word
    other = min(math.log((n1 - m1 + 1) / (n1 + 1)) - math.log((n0 - m0 + 1) / (n0 + 1)), -0.005)
    model = Model(scores, other, repeats=repeats)
    freq = [((first[w][0] + PRIOR_SHARE * sum(first[w])) / (n0 + a0), s) for w, s in scores.items()]
    model.lam = _lambda(freq, other)
    _calibrate(model, train)
    return model


def _lambda(freq: list[tuple[float, float]], other: float) -> float:
    """Positive root of sum p exp(lambda s) = 1 over the clean distribution."""
    rest = 1 - sum(p for p, _ in freq)

    def f(x: float) -> float:
        return rest * math.exp(x * other) + sum(p * math.exp(min(x * s, 500)) for p, s in freq) - 1

    if not any(s > 0 for _, s in freq):
        return 1.0
    low, high = 1e-6, 1e-6
    while f(high) <= 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) <= 0 else (low, mid)
    return high


def _calibrate(model: Model, train: DataFrame) -> None:
    def run(batches):
        scorer = Scorer(model)
        for texts, ys in rows(batches, "t", "y"):
            n, best, count, total = [], [], [], []
            for t in texts:
                words, found = scorer(t)
                n.append(words)
                best.append(max((s for *_, s in found), default=0.0))
                count.append(len(found))
                total.append(sum(s for *_, s in found))
            yield pa.RecordBatch.from_pydict({"y": pa.array([1 if y == 1 else 0 for y in ys], pa.int32()), "n": pa.array(n, pa.int64()),
                                              "s": pa.array(best, pa.float64()), "c": pa.array(count, pa.int64()),
                                              "total": pa.array(total, pa.float64())})

    scored = train.mapInArrow(run, "y int, n long, s double, c long, total double")
    # one table of (class, length, score) bins feeds the law and the curve
    bins = (scored.groupBy("y", F.floor(4 * F.log2(F.greatest("n", F.lit(1)))).alias("nb"), F.round("s", 2).alias("s"))
            .agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("total").alias("total"))
            .groupBy("y", "nb", F.floor(F.col("s") / BIN).alias("sb"))
            .agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("total").alias("total")).collect())
    clean = [r for r in bins if r["y"] == 0]
    # chance segments per clean word at the least score a segment has, carried
    # back to score zero by the law; one is added for those not seen yet
    least = min((v for v in [*model.scores.values(), *model.repeats.values()] if v > 0), default=0.0)
    chance = sum(r["c"] for r in clean)
    # the mean score beyond the least is 1 / lambda under the law
    beyond = sum(r["total"] for r in clean) - chance * least
    if beyond > 0:
        model.lam = min(model.lam, chance / beyond)
    model.k = (chance + 1) * math.exp(model.lam * least) / max(1.0, sum(r["n"] for r in clean))
    x = np.array([model.evidence((r["sb"] + 0.5) * BIN if r["sb"] > 0 else 0.0, round(2 ** ((r["nb"] + 0.5) / 4)))
                  for r in bins])
    y = np.array([r["y"] for r in bins], float)
    w = np.array([r["rows"] for r in bins], float)
    model.bias, model.slope = fit_logistic(x, y, w)


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Newton steps on weighted bins; the slope is kept from turning negative."""
    mean, dev = np.average(x, weights=w), max(1e-9, float(np.sqrt(np.cov(x, aweights=w)))) if len(x) > 1 else 1.0
    a = np.stack([np.ones_like(x), (x - mean) / dev], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (w * (y - p)) - ridge * beta
        h = (a * (w * p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(float(beta[1]) / dev, 0.0)
    return float(beta[0]) - slope * float(mean), slope


# -- scoring -------------------------------------------------------------------
SEGMENTS = "array<struct<first_word:int,end_word:int,score:double,evalue:double>>"


def score(df: DataFrame, model: Model, text: str = "text", out: str = "toxic_score",
          with_segments: bool = False) -> DataFrame:
    """Appends ``out`` (0 to 1) and, on request, ``<out>_segments``: the word
    spans with score and E-value.  Null and empty texts have no segment and
    score low; every other column passes through."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema = f"{fields}, `{out}` double" + (f", `{out}_segments` {SEGMENTS}" if with_segments else "")

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            p, spans = [], []
            for t in b.column(text).to_pylist():
                n, found = scorer(t)
                p.append(model.probability(model.evidence(max((s for *_, s in found), default=0.0), n)))
                spans.append([{"first_word": i, "end_word": j, "score": s,
                               "evalue": math.exp(min(-model.evidence(s, n), 700.0))} for i, j, s in found])
            cols, names = [*b.columns, pa.array(p, pa.float64())], [*b.schema.names, out]
            if with_segments:
                cols, names = [*cols, pa.array(spans, pa.list_(pa.struct([
                    ("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()),
                    ("evalue", pa.float64())])))], [*names, f"{out}_segments"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted (1 from 0.7 on)."""
    model = learn(docs, labels, key, text)
    scored = score(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), model, "t", "score")
    return scored.select(F.col("k").alias(key), is_held_out(F.col("k"), 3, 1).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose score stays under 0.7, with their columns."""
    model, name = learn(docs, labels, key, text), "toxic_score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, text, name).where(F.col(name) < THRESHOLD).select(*[f"`{c}`" for c in docs.columns])
