import hashlib
import random

from helpers import SMALL, docs
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeflow.llm import suffix_dedup as sd


def brute(rows):
    """(key, n_bytes, n_removed, n_spans, kept) by looking up every window."""
    order = sorted(range(len(rows)), key=lambda i: (
        rows[i][0] is not None, rows[i][0] or 0, hashlib.sha256((rows[i][1] or "").encode()).digest()[:8]))
    # texts of one key are ordered by their hash as a signed number
    order.sort(key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, int.from_bytes(
        hashlib.sha256((rows[i][1] or "").encode()).digest()[:8], "big", signed=True)))
    seen, out = set(), []
    for i in order:
        b = (rows[i][1] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p:p + 100]
            if w in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((rows[i][0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(df, **kw):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r[c] for c in cols) for r in sd.remove_repeats(df, **kw).collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=6).map(str.encode), max_size=8).map(sorted), max_size=7))
def test_loser_tree_merges_with_prefixes(runs):
    def lcp(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    coded = [(r, [0] + [lcp(a, b) for a, b in zip(r, r[1:])]) for r in runs]
    of, got = sd.merge_runs(coded)
    at, out = [0] * len(runs), []
    for k in of:
        out.append(runs[k][at[k]])
        at[k] += 1
    assert out == sorted(x for r in runs for x in r)
    assert got == ([0] + [lcp(a, b) for a, b in zip(out, out[1:])] if out else [])
    pairs = list(zip(out, of))
    assert all(a[0] != b[0] or a[1] <= b[1] for a, b in zip(pairs, pairs[1:]))  # ties: earlier run first


def test_run_round_trip():
    rnd = random.Random(3)
    items = sorted({(bytes(rnd.choices(b"ab\0", k=rnd.randint(85, 101))), b"l" * 16, 0, 3, rnd.randint(-9, 9), -5, 7)
                    for _ in range(200)})
    s, _, left, jlo, jhi, doc, rid, start = sd.decode_run(sd.encode_run(items))
    assert s == [i[0] for i in items] and doc.tolist() == [i[4] for i in items]
    assert set(rid.tolist()) == {-5} and set(start.tolist()) == {7} and set(jhi.tolist()) == {3}


def _texts():
    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcdeé", k=rnd.randint(2, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rnd.choices(words, k=n))

    line = prose(30)
    base = prose(120)
    texts = [prose(rnd.randint(1, 200)) for _ in range(12)]
    texts += [prose(40) + line + prose(40) for _ in range(8)] + [line, line[:-1], line[1:] + "x"]
    for _ in range(6):  # near copies
        w = base.split(" ")
        w[rnd.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [base, base, None, "", "short", "short", "a" * 99, "a" * 100, "a" * 101, "a" * 350,
              "ab" * 300 + prose(5), (line + "\n") * 4, prose(20) * 3, "\0" * 220]
    return texts


def test_against_every_window(spark):
    texts = _texts()
    assert run(docs(spark, texts)) == brute(list(enumerate(texts)))


def test_hot_grams_are_dealt_window_by_window(spark):
    texts = _texts()
    assert run(docs(spark, texts), hot=1) == brute(list(enumerate(texts)))


def test_many_runs_and_slices(spark, monkeypatch):
    texts = _texts()
    for name, value in (("SLICE", 256), ("RUN_ITEMS", 40), ("BUFFER", 300)):
        monkeypatch.setattr(sd, name, value)
    # in this process: the same code the tasks run
    import pyarrow as pa
    import zstandard
    zs = [zstandard.compress((t or "").encode()) for t in texts if len((t or "").encode()) >= 100]
    b = pa.RecordBatch.from_pydict({"rid": list(range(len(zs))), "z": zs})
    sliced = sorted(r for x in sd._anchor_rows(iter([b])) for r in zip(*x.to_pydict().values()))
    monkeypatch.setattr(sd, "SLICE", 1 << 22)
    whole = sorted(r for x in sd._anchor_rows(iter([b])) for r in zip(*x.to_pydict().values()))
    assert {r[:2] for r in sliced} == {r[:2] for r in whole}


def test_null_and_shared_keys(spark):
    t = _texts()
    rows = [(None, t[12]), (None, t[12]), (5, t[13]), (5, t[14]), (5, t[14]), (-3, t[15]), (9, t[16]), (9, None)]
    assert run(docs(spark, [r[1] for r in rows], [r[0] for r in rows])) == brute(rows)


def test_empty_table(spark):
    assert run(docs(spark, []).limit(0)) == []


def test_small_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert run(df) == brute(rows)
