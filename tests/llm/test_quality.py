import random

import numpy as np
from helpers import SMALL, docs
from pyspark.sql import functions as F

from gradeflow.llm import quality as q


def plain_statistics(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    three = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count, covered = {}, set()
    for t in three:
        count[t] = count.get(t, 0) + 1
    for i, t in enumerate(three):
        if count[t] > 1:
            covered |= {i, i + 1, i + 2}
    n = len(words)
    return (n, sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


COLS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def odd_texts():
    rnd = random.Random(1)
    out = [None, "", " \t\n", "one", "one two", "a b c", "a b c a b c", "a a a a a a", "x y z", "é ü #*$\n\n<>|",
           "l1 x\nl1 x\n \nl1 x\nl2", "a b c d a b c", "a b a b a b a", "\x1c a", "w " * 3000]
    for _ in range(60):
        out.append(rnd.choice([" ", "\n", "\t "]).join(rnd.choices("abcde", k=rnd.randint(1, 200))))
    return out


def test_statistics(spark):
    texts = odd_texts()
    got = {r["doc_id"]: tuple(r[c] for c in COLS) for r in q.statistics(docs(spark, texts, None, "n_words_")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_statistics(t), repr(t)[:80]


def test_small_table_statistics(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in q.quality(df).collect():
        assert tuple(r[c] for c in COLS) == plain_statistics(text[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def plain_estimate(x):
    """The concentration steps in numpy."""
    floors = np.array(list(q.FLOORS.values()))
    m = np.array([sorted(c)[(len(c) + 1) // 2 - 1] for c in x.T])
    d = np.array([sorted(c)[(len(c) + 1) // 2 - 1] for c in abs(x - m).T])
    cov, last = np.diag((1.4826 * d) ** 2 + floors ** 2), None
    for _ in range(q.STEPS):
        inv = np.linalg.inv(cov)
        d2 = np.einsum("ij,jk,ik->i", x - m, inv, x - m)
        b = np.floor(np.log(np.maximum(d2, 1e-9)) * q.BINS)
        edge = np.sort(b)[int(np.ceil(q.SUBSET * len(x))) - 1]
        near = x[b <= edge]
        m, cov = near.mean(0), np.cov(near.T, bias=True) + np.diag(floors ** 2)
        det = np.linalg.slogdet(cov)[1]
        if last is not None and abs(det - last) <= q.SETTLED * max(1, abs(det)):
            break
        last = det
    d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
    b = np.floor(np.log(np.maximum(d2, 1e-9)) * q.BINS)
    scale = max(1.0, np.exp((np.sort(b)[int(np.ceil(0.5 * len(x))) - 1] + 1) / q.BINS) / q.CHI_MEDIAN)
    return d2 / scale


def test_estimate_agrees_and_resists_outliers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, q.P)) @ rng.normal(size=(q.P, q.P)) + 5
    x[:80] += 40  # a fifth of the rows, all on one side
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], ["g", *q.X]).repartition(5)
    est = q.robust_estimates(df)
    got = np.array([r[0] for r in df.join(est, "g").select((q._distance() / F.col("scale")).alias("d"), *q.X)
                   .orderBy(*q.X).select("d").collect()])
    want = plain_estimate(x)[np.lexsort(x.T[::-1])]
    assert np.allclose(got, want, rtol=1e-6)
    d = plain_estimate(x)
    assert (d[:80] > q.CHI_LIMIT).all() and (d[80:] <= q.CHI_LIMIT).mean() > 0.99


def test_outliers_go_and_clean_rows_stay(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdefghijkl", k=rnd.randint(2, 9))) for _ in range(2000)]
    clean = [" ".join(rnd.choices(words, k=rnd.randint(60, 800))) for _ in range(300)]
    junk = [" ".join(w + "###&&&$$$" for w in rnd.choices(words, k=200)) for _ in range(20)]
    texts = clean + junk + ["too short"]
    rows = [(k if k % 50 else None, t, None if k % 3 else "en", "s") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = [(r["n_symbols"] > 0, r["kept"], r["base_failed"]) for r in q.quality(df).collect()]
    assert len(got) == len(rows)
    assert all(not kept for sym, kept, failed in got if sym)
    assert sum(kept for sym, kept, failed in got if not sym and not failed) >= 298


def test_few_rows_and_empty_table(spark):
    df = docs(spark, ["w " * 5, " ".join(map(str, range(80))), None])
    assert [(r["doc_id"], r["kept"]) for r in q.quality(df).orderBy("doc_id").collect()] == [(0, False), (1, True), (2, False)]
    assert q.quality(df.limit(0)).collect() == []


def test_planted_repetition_goes_and_one_repeated_line_stays(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghijkl", k=rnd.randint(4, 9))) for _ in range(3000)]

    def lines(n):
        return [" ".join(rnd.choices(words, k=10)) for _ in range(n)]

    clean = ["\n".join(lines(rnd.randint(6, 60))) for _ in range(400)]
    kinds = {"clean": clean, "one line": [], "lines": [], "phrases": []}
    for n in (100, 200, 400, 800) * 5:
        x, own = lines(n // 10), rnd.choice(lines(1))
        kinds["one line"].append("\n".join([x[-1], *x[1:]]))
        # 30 % of the words in copies of one line, between lines of their own
        copies = [own] * (3 * n // 100)
        mixed = copies + x[:n // 10 - len(copies)]
        rnd.shuffle(mixed)
        kinds["lines"].append("\n".join(mixed))
        # 40 % of the words in copies of a phrase of four words, all on one line
        parts = [own.split()[:4]] * (n // 10) + [ws.split()[:6] for ws in x]
        rnd.shuffle(parts)
        kinds["phrases"].append(" ".join(w for part in parts for w in part))
    rows = [(f"{kind} {k}", t, "en", "s") for kind, ts in kinds.items() for k, t in enumerate(ts)]
    got = q.quality(spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")).collect()
    assert not any(r["base_failed"] for r in got)
    kept = {kind: [r["kept"] for r in got if r["doc_id"].startswith(kind + " ")] for kind in kinds}
    assert sum(kept["clean"]) >= 398 and all(kept["one line"])
    assert not any(kept["lines"]) and not any(kept["phrases"])
