import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from helpers import SMALL, small
from oracle import compare, duck

from gradeflow.llm import prefix_trie, queries

COLS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    """The trie over materialised rebuilt conversations."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = []
    for s, m in members.items():
        below = [x for x in members if x[:len(s)] == s]
        children = [x for x in below if len(x) == len(s) + 1]
        ends = sorted(c for c in m if len(built[c]) == len(s))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children),
                    sum(not any(y[:-1] == x for y in members if y) for x in below),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows],
                               "conv_id long, turn long, role string, text string, node string, depth long")
    got = prefix_trie.trie_of_conversations(df).collect()
    return sorted((tuple(r[c] for c in COLS) for r in got), key=lambda r: (r[1], r[0]))


def random_rows(seed, n):
    """Short conversations of few texts, so that prefixes are shared."""
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(0, 400), n) + [0, 100, 300]:
        for t in range(rnd.randint(1, 8)):
            rows.append((c, rnd.choice([t, t, t, None, 2]), rnd.choice(["user", "assistant", None]),
                         rnd.choice(["", "a", "bé", None, "a"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, seed):
    rows = random_rows(seed, 60)
    assert run(spark, rows) == plain(rows)


def test_small_table_and_sql(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in small("conversations")]
    assert run(spark, rows) == plain(rows)
    got = queries.QUERIES["op13_prefix_trie"](spark, SMALL).toPandas()
    ok, why = compare(got, duck(queries.ORACLE_SQL["op13_prefix_trie"], SMALL))
    assert ok, why


def test_edges(spark):
    assert run(spark, []) == []
    # crc32("1") % 6 turns come from conversation 0, which is absent: fewer own turns than that leave none
    h = zlib.crc32(b"1") % 6
    short = [(1, t, "user", "x") for t in range(h)]
    assert run(spark, short) == plain(short) and len(run(spark, short)) == 1
    odd = [(None, 0, "user", "x"), (7, None, None, None), (7, None, None, None), (7, 0, "user", "y" * 100_000)]
    assert run(spark, odd) == plain(odd)
    copies = [(c, t, "user", f"turn {t}") for c in range(200, 260) for t in range(8)]
    assert run(spark, copies) == plain(copies)


def test_long_conversation(spark):
    rows = [(5, t, "user", str(t % 7)) for t in range(3000)] + [(6, t, "user", str(t % 7)) for t in range(2500)]
    got = run(spark, rows)
    assert got == sorted(got, key=lambda r: (r[1], r[0]))
    root = got[0]
    assert root[1] == 0 and root[3] == 2 and max(r[1] for r in got) <= 3000


def test_monoid_and_collisions(spark, monkeypatch):
    x = prefix_trie.MULTIPLIERS[0]
    turns = [(3, -4), (5, 6), (-(1 << 63), (1 << 63) - 1), (0, 0)]
    def product(ts, at=0):
        for t in ts:
            at = prefix_trie.add_turn(at, *t, x)
        return at
    for cut in range(5):
        tail = turns[cut:]
        assert product(turns) == (product(turns[:cut]) * pow(x, len(tail), prefix_trie.PRIME) + product(tail)) % prefix_trie.PRIME
    # a multiplier of one makes products of permuted turns equal: found, and the next one is used
    rows = [(100 * c, t, "user", str(x)) for c, order in enumerate([(1, 2), (2, 1)]) for t, x in enumerate(order)]
    monkeypatch.setattr(prefix_trie, "MULTIPLIERS", (1, x))
    assert run(spark, rows) == plain(rows)
    monkeypatch.setattr(prefix_trie, "MULTIPLIERS", (1,))
    with pytest.raises(ArithmeticError):
        run(spark, rows)
