import random
import zlib

import numpy as np
from helpers import collect, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeflow.llm import toxicity as tx


def plain_segments(scores):
    """Maximal segments by definition: the best one first (leftmost, shortest),
    then both sides on their own."""
    def best(a, b):
        out = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-9 and (out is None or total > out[2] + 1e-9):
                    out = (i, j + 1, total)
        return out

    def walk(a, b):
        m = best(a, b)
        return [] if m is None else walk(a, m[0]) + [m] + walk(m[1], b)

    return walk(0, len(scores))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-1.0, 2.25, 5.5, -3.75, -1.0, -1.0]), max_size=14))
def test_segments_are_the_maximal_ones(scores):
    s = np.array(scores)
    at = np.flatnonzero(s != -1.0)
    got = tx.segments(at, s[at], len(s), -1.0)
    want = plain_segments(scores)
    assert sum(x for *_, x in got) == sum(x for *_, x in want)
    assert max((x for *_, x in got), default=0) == max((x for *_, x in want), default=0)
    assert sorted(x for *_, x in got) == sorted(x for *_, x in want)


def is_held(k):
    return zlib.crc32(str(k).encode()) % 3 == 1


def planted(n=1500):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 6))) for _ in range(1500)]
    bad = ["grubble", "snarkly", "vexor", "dreckle"]
    rows = []
    for k in range(n):
        w, toxic = rnd.choices(words, k=rnd.randint(5, 120)), k % 6 == 0
        if toxic:
            for _ in range(max(1, len(w) // 12)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["", "(", "\""]) + rnd.choice(bad).upper() + rnd.choice(["", "!", ",", "###"]))
        rows.append((k, " ".join(w), int(toxic)))
    return rows


def test_held_out_texts(spark):
    rows = planted()
    df = docs(spark, [t for _, t, _ in rows], [k for k, _, _ in rows], "score")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    # what is held out teaches nothing: its labels may be anything
    from pyspark.sql import functions as F
    labels = labels.withColumn("toxic", F.when(tx.is_held_out(F.col("doc_id"), 3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    got = {r["doc_id"]: r for r in tx.toxicity(df, labels).collect()}
    assert len(got) == len(rows)
    truth = {k: y for k, _, y in rows}
    out = [k for k in got if got[k]["held_out"]]
    assert set(out) == {k for k in truth if is_held(k)}
    hit = [got[k]["predicted"] == truth[k] for k in out]
    assert sum(hit) / len(hit) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_spans_of_a_passage(spark):
    m = tx.Model({b"bad": 5.0, b"awful": 4.0}, other=-0.5, lam=1.0, k=0.01, slope=1.0, bias=-2.0)
    df = docs(spark, ["a b BAD c awful! d e f g h i j k l m bad", None, ""], None, "p")
    got = {r["doc_id"]: r for r in tx.score(df, m, with_segments=True, out="p2").collect()}
    assert [(s["first_word"], s["end_word"], s["score"]) for s in got[0]["p2_segments"]] == [(2, 5, 8.5)]
    assert got[1]["p2_segments"] == [] and got[2]["p2"] < 0.2


def test_odd_tables(spark):
    rows = planted(300)
    df = docs(spark, [t for _, t, _ in rows] + [None, "", "x"], [k for k, _, _ in rows] + [None, 5000, 5000])
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (3, None), (3, 1)], "doc_id long, toxic int")
    out = tx.toxicity(df, labels)
    assert out.count() == 303
    assert tx.toxicity(df.limit(0), labels).collect() == []
    assert {r["predicted"] for r in tx.toxicity(df, labels.limit(0)).collect()} == {0}
    kept = tx.drop_toxic(df, labels)
    assert kept.columns == df.columns
    bad = {r["doc_id"] for r in out.collect() if r["predicted"]}
    assert bad and {r[0] for r in collect(kept, "doc_id")} == {r["doc_id"] for r in out.collect() if not r["predicted"]} | set()


def test_every_occurrence_scores(spark):
    rows = planted()
    df = docs(spark, [t for _, t, _ in rows], [k for k, _, _ in rows])
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = tx.learn(df, labels)
    rnd = random.Random(3)
    clean = [t for _, t, y in rows if not y]

    def filler(n):
        return " ".join(rnd.choices(" ".join(clean[:200]).split(), k=n))

    dense = "GRUBBLE snarkly vexor dreckle " * 3
    scorer = tx.Scorer(model)
    # a second passage with the same words is a segment as the first is
    n, found = scorer(" ".join([filler(3000), dense, filler(3000), dense, filler(3000)]))
    at = [a for a, b, s in found if s > 5 * max(model.scores.values())]
    assert at == [3000, 6012]
    # a passage of one repeated word is more than one hit
    once, often = (max(s for *_, s in scorer(t)[1]) for t in ("x grubble y", "x grubble grubble grubble grubble y"))
    assert often > 2.5 * once
    # words that occurred scattered before do not hide a dense passage
    scattered = " ".join(filler(2500) + " " + w for w in ("grubble", "snarkly", "vexor", "dreckle"))
    hidden = docs(spark, [scattered + " " + filler(2500) + " " + dense + filler(2500), filler(10_000)])
    got = {r["doc_id"]: r["p"] for r in tx.score(hidden, model, out="p").collect()}
    assert got[0] >= tx.THRESHOLD > got[1]
    assert set(model.repeats) == set(model.scores) and len(model.scores) >= 4
    assert all(0 < model.repeats[w] <= model.scores[w] for w in model.scores)


def test_string_keys_learn_the_same(spark):
    """Keys only tell documents apart: held-out rows follow their text, so a table of padded string keys is learnt from alike."""
    rows = planted(200)
    from pyspark.sql import functions as F
    df = docs(spark, [t for _, t, _ in rows], [k for k, _, _ in rows]).withColumn("doc_id", F.format_string("d%06d", "doc_id"))
    labels = spark.createDataFrame([(f"d{k:06d}", y) for k, _, y in rows], "doc_id string, toxic int")
    got = tx.toxicity(df, labels).collect()
    assert len(got) == len(rows) and {r["held_out"] for r in got} == {True, False}
    truth = {f"d{k:06d}": y for k, _, y in rows}
    hit = [r["predicted"] == truth[r["doc_id"]] for r in got]
    assert sum(hit) / len(hit) > 0.95
