import random

import numpy as np
import xxhash
from helpers import SMALL, collect, docs

from gradeflow.llm import simhash as sh


def plain_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] * bool(words)
    fp = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles):
            fp |= 1 << bit
    return fp


def plain_components(rows, radius=2):
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        if k is not None:
            low[r] = min(low.get(r, k), k)
    return sorted(((k, f"{f:016x}", low.get(find(i))) for i, ((k, _), f) in enumerate(zip(rows, fps))), key=repr)


def variants(n, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefg", k=4)) for _ in range(300)]
    base = rnd.choices(words, k=400)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        out.append(" ".join(w))
    return out


def run(df, **kw):
    return sorted((tuple(r) for r in sh.near_duplicates(df, **kw).select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_small_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert run(df) == plain_components([(r["doc_id"], r["text"]) for r in df.collect()])


def test_groups_across_shards(spark, monkeypatch):
    monkeypatch.setattr(sh, "SHARD_ROWS", 8)
    monkeypatch.setattr(sh, "LEAF_ROWS", 4)
    rnd = random.Random(4)
    texts = variants(60) + variants(20, 9) + [" ".join(rnd.choices("abcdefgh", k=rnd.randint(1, 40))) for _ in range(60)]
    texts += [None, "", "  ", "One", "one", "ONE two"]
    rows = [(k * 7 % 997, t) for k, t in enumerate(texts)]
    assert run(docs(spark, [t for _, t in rows], [k for k, _ in rows], "fp")) == plain_components(rows)


def test_null_and_repeated_keys(spark):
    rows = [(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "A b  c"), (None, "lonely text here")]
    got = run(docs(spark, [t for _, t in rows], [k for k, _ in rows], "component_id"))
    assert got == plain_components(rows)


def test_one_of_each_keeps_columns(spark):
    rows = [(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "A b  c"), (2, "A b  c"), (None, "lonely text here"), (9, "x y z w")]
    df = docs(spark, [t for _, t in rows], [k for k, _ in rows], "__fp")
    out = sh.one_of_each(df)
    assert out.columns == df.columns
    assert collect(out, "doc_id", "text") == [(None, "lonely text here"), (2, "A b  c"), (9, "x y z w")]


def test_tree_routes_every_close_pair():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    tree, n = sh.layout(x, 5)
    assert n > 8
    home = {}
    for i, s in zip(*sh.route(tree, x, 0)):
        assert i not in home
        home[i] = s
    asked = set(zip(*(a.tolist() for a in sh.route(tree, y, 2))))
    assert all((i, home[i]) in asked for i in range(400))
    found = {(i, j) for a, b in sh.close_pairs(x, y, 2) for i, j in zip(a.tolist(), b.tolist())}
    assert found == {(i, j) for i in range(400) for j in range(400) if int(x[i] ^ y[j]).bit_count() <= 2}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "src long, dst long")
    got = dict(map(tuple, sh.components(edges).collect()))
    assert got == {k: 0 for k in range(1, 61)} | {101: 100}


def test_empty_table(spark):
    assert run(docs(spark, []).limit(0)) == []
