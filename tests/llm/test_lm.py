import math
import zlib
from collections import Counter

import numpy as np
from helpers import SMALL, docs

from gradeflow.llm import lm


def words(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() + [b""]


def held(k):
    return zlib.crc32(str(k).encode() if k is not None else b"") % 7 == 2


def plain(rows):
    c = Counter(w for k, t in rows if not held(k) for w in words(t))
    n, v = sum(c.values()), len(c)
    return n, sorted(((k, held(k), len(words(t)), sum(c[w] > 0 for w in words(t)),
                       sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for k, t in rows), key=repr)


def check(df, rows):
    got = lm.lm_scores(df).collect()
    n, want = plain(rows)
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} <= {n}
    for g, w in zip(sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=repr),
                    want):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-6 * max(1, abs(w[4]))
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    return got


def test_small_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = check(df, [(r["doc_id"], r["text"]) for r in df.collect()])
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > 1.02 * sum(r["base_score"] for r in out)  # better: nearer to zero


def test_odd_rows(spark):
    texts = [None, "", " ", "A a é", "x " * 40, "x " * 40, "A a é"] + ["the end of it"] * 20
    ids = [None, 1, 2, 3, 4, 4, None] + list(range(10, 30))
    check(docs(spark, texts, ids, "score"), list(zip(ids, texts)))
    assert lm.lm_scores(docs(spark, []).limit(0)).collect() == []


def test_model_is_a_distribution(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("text").withColumnRenamed("text", "t")
    counts = lm.token_counts(df)
    voc = lm.Vocabulary.of(counts)
    c = {bytes(r["w"]): r["n"] for r in counts.collect()}
    assert (voc.n, voc.v) == (sum(c.values()), len(c))
    inside = np.zeros(lm.CLASSES)
    for w, n in c.items():
        k = voc.class_of(w)
        inside[k] += 1.0 if k < lm.SINGLE else (n + 1) / (voc.class_n[k] + voc.class_v[k] + 1)
    shared = np.arange(lm.CLASSES) >= lm.SINGLE
    inside[shared] += 1 / (voc.class_n[shared] + voc.class_v[shared] + 1)  # the unknown word
    assert np.allclose(inside, 1)
    model = lm.Softmax.start(voc.class_n)
    rng = np.random.default_rng(1)
    f, cls = rng.integers(0, 50, (lm.FEATURES, 3000)), rng.integers(0, lm.CLASSES, 3000)
    before = model.log10(f, cls).sum()
    for _ in range(5):
        model.step(f, cls)
    assert np.allclose(model.probabilities(f).sum(1), 1, atol=1e-5)
    assert model.log10(f, cls).sum() > before


def test_contexts_stay_inside_a_text():
    a, b = np.array([7, 8, 9], np.uint16).tobytes(), np.array([7, 8], np.uint16).tobytes()
    both, alone = lm.buckets([a, b, b""]), lm.buckets([b])
    assert (both[:, 3:] == alone).all() and (both[:, :2] == alone).all()


def test_group_sums_add_every_row():
    rng = np.random.default_rng(3)
    for high in (1, 3, 40, 5000):  # frequent keys, rare keys, both
        key = np.minimum(rng.integers(0, high, 1000), rng.integers(0, high, 1000))
        g = rng.normal(size=(1000, lm.CLASSES)).astype(np.float32)
        row, count, total = lm.group_sums(g, key)
        assert (row == np.unique(key)).all() and (count == np.unique(key, return_counts=True)[1]).all()
        assert np.allclose(total, [g[key == k].sum(0, dtype=np.float64) for k in row], atol=1e-4)


def test_scores_with_and_without_ceiling():
    rng = np.random.default_rng(2)
    f, cls = rng.integers(0, lm.BUCKETS, (lm.FEATURES, 6000)), rng.integers(0, lm.CLASSES, 6000)
    model = lm.Softmax.start(np.ones(lm.CLASSES, np.int64))
    for size in (1, 100):  # below and above the ceiling
        model.weights[:] = rng.normal(size=model.weights.shape) * size
        model.bounded = None
        z = np.minimum(model.weights[f].sum(0) + model.bias, lm.CEILING).astype(np.float64)
        want = (z - np.log(np.exp(z).sum(1))[:, None])[np.arange(6000), cls] / math.log(10)
        assert np.allclose(model.log10(f, cls), np.maximum(want, -30), atol=1e-3)
        assert model.bounded == (size == 1)
