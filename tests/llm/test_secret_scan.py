import hashlib
import random
import re

from helpers import collect, docs
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gradeflow.llm import secret_scan as ss

HEX = "b7db7aa4a5fcc78305"


def prose(rnd, n):
    return " ".join(rnd.choice(["house", "river", "green", "walking", "paper", "light", "window", "seven"]) for _ in range(n))


def corpus(n=120):
    rnd = random.Random(3)
    out = []
    for k in range(n):
        t = prose(rnd, rnd.randint(12, 60))
        if k % 3 == 0:
            t += f' token = "{hashlib.sha1(str(k).encode()).hexdigest()}" ' + prose(rnd, 5)
        if k % 4 == 0:
            t = f"password={hashlib.md5(str(k).encode()).hexdigest()[:18]} " + t
        if k % 5 == 0:
            t += " AKIAMD62HKU6VBLCCCC" + "ABCDE"[k % 5] + " end"
        if k % 6 == 0:
            t += " see page/river/green/window/123 and walking-paper-light-window-77 ok"
        out.append(t)
    return out


def test_candidates_are_all_found(spark):
    texts = corpus() + [None, "", "plain", f"x={HEX}", f"TOKEN = {HEX}!! a", "pwd:short", "a" * 50, "1" * 50, "a1" * 40,
                        "/a" * 30_000 + "1"]
    df = ss.scan(docs(spark, texts, None, "secret_findings"), None)
    for r in df.collect():
        t = texts[r["doc_id"]] or ""
        assert [f["found"] for f in r["secret_findings"]] == ss.candidates_of(t)
        assert r["redacted_text"] == (texts[r["doc_id"]] if not ss.candidates_of(t) else r["redacted_text"])


def test_forest_as_sql_votes_like_the_model(spark):
    labelled = ss.labelled_findings(docs(spark, corpus()))
    data = labelled.select(ss.features(F.col("c"), F.col("p")).alias("x"), F.col("label").cast("double").alias("label"))
    assert {r[0] for r in data.select("label").distinct().collect()} == {0.0, 1.0}
    model = RandomForestClassifier(numTrees=7, maxDepth=4, seed=2).fit(data.withColumn("features", array_to_vector("x")))
    votes = F.expr(ss.forest_sql(model))
    scored = data.select("x", votes.alias("v"))
    rows = [(r["x"], r["v"]) for r in scored.collect()]
    for x, v in rows[:200]:
        want = sum(t.predict(Vectors.dense(x)) for t in model.trees) / 7
        assert abs(v - want) < 1e-12


def test_secrets_go_and_decoys_stay(spark):
    texts = corpus()
    out = {r["doc_id"]: r for r in ss.scan(docs(spark, texts), ss.fit(ss.labelled_findings(docs(spark, texts)))).collect()}
    for k, t in enumerate(texts):
        red = out[k]["redacted_text"]
        assert not re.search(r"[0-9a-f]{18}", red) and "AKIA" not in red
        if k % 6 == 0:
            assert "page/river/green/window/123" in red and "walking-paper-light-window-77" in red
        masked = re.sub(r'(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}|AKIA[0-9A-Z]{16}', ss.MASK, t)
        assert red == masked


def test_native_plan(spark):
    df = docs(spark, corpus())
    for plan in (ss.secrets(df), ss.redact(df)):
        text = plan._jdf.queryExecution().toString()
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_redact_keeps_rows_and_columns(spark):
    texts = corpus() + [None, "", f"password={HEX}"]
    df = docs(spark, texts, [None if k % 9 == 0 else k for k in range(len(texts))], "__p")
    out = ss.redact(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    rows = out.collect()
    assert len(rows) == len(texts) and {r["__p"] for r in rows} == {"x"}
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
    assert f"password={ss.MASK}" in {r["text"] for r in rows}


def test_without_labels_every_candidate_stays(spark):
    df = docs(spark, [f"password={HEX}"])
    assert collect(ss.secrets(df), "n_candidates", "n_secrets") == [(1, 1)]
    assert ss.secrets(df.limit(0)).collect() == []


def test_copies_do_not_fill_the_labelled_sample(spark, monkeypatch):
    monkeypatch.setattr(ss, "LABELLED_ROWS", 40)
    copies = [f'password = "changeme-sample-{n}a1b2" in the footer that many pages share' for n in range(6)] * 50
    keys = [f'token = "{hashlib.sha1(str(n).encode()).hexdigest()}" ' + prose(random.Random(n), 9) for n in range(12)]
    df = docs(spark, copies + keys).withColumn("source", F.lit("s"))
    got = [(r["c"]["found"], r["label"]) for r in ss.labelled_findings(df).collect()]
    real = [f for f, y in got if f.startswith('password = ') or y == 1]
    assert len(real) == len(set(real)) == 18
    assert sum(y for _, y in got) == 12


def test_many_rows_of_a_label_leave_the_other(spark, monkeypatch):
    labelled = ss.labelled_findings(docs(spark, corpus()))
    zeros = labelled.where("label = 0").count()
    assert labelled.where("label = 1").count() > 0
    monkeypatch.setattr(ss, "LABELLED_ROWS", zeros // 2)
    assert ss.fit(labelled) is not None
