import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from helpers import SMALL, small
from oracle import compare, duck
from pyspark.sql import functions as F

from gradeflow.llm import queries, repair

COLS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
LEGAL = re.compile(r"(s?(ua)+)?\Z")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_repair(rows, limit):
    """(cost, audit, repaired rows) of every edit sequence of cost ``limit`` at most."""
    marks = faults(rows)

    def walk(i, cost, audit, out):
        if i == len(rows) and LEGAL.match("".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for r, _ in out)):
            yield cost, audit, out
        if cost + 2 <= limit:
            for role in ("user", "assistant"):
                yield from walk(i, cost + 2, audit + "I", [*out, (role, "")])
        if i < len(rows):
            role, text = rows[i]
            if cost + 3 <= limit:
                yield from walk(i + 1, cost + 3, audit + "D", out)
            if marks[i] not in ("blank", "duplicate"):
                stays = marks[i] == "truncated"
                if cost + stays <= limit:
                    yield from walk(i + 1, cost + stays, audit + "K", [*out, (role, text)])
                if cost + 2 + stays <= limit:
                    for other in ("user", "assistant"):
                        yield from walk(i + 1, cost + 2 + stays, audit + "R", [*out, (other, text)])
    yield from walk(0, 0, "", [])


def plain(rows):
    for limit in itertools.count():
        found = sorted((c, a, "\n".join(f"{r}:{t}" for r, t in out)) for c, a, out in every_repair(rows, limit))
        if found:
            return found[0]


def codes_of(rows):
    return "".join("d" if m in ("blank", "duplicate") else (lambda x: x.upper() if m else x)(r[:1] if r[:1] in ("s", "u", "a") else "x")
                   for (r, _), m in zip(rows, faults(rows))).encode()


def test_search_against_every_edit_sequence():
    rnd = random.Random(5)
    for _ in range(300):
        rows = [(rnd.choice(["user", "assistant", "system", "tool", ""]), rnd.choice(["Yes.", "No", " ", "Why?", "So it"]))
                for _ in range(rnd.randint(0, 5))]
        cost, audit, text = plain(rows)
        assert repair.search(codes_of(rows)) == (cost, audit), rows
        got = "\n".join(f"{r}:{t}" for _, r, t in repair.apply_edits(rows, audit))
        assert got == text, rows


def by_levels(codes):
    """Cheapest (cost, audit) per state, row by row: a plain check for longer conversations."""
    def inserted(now):
        for _ in range(2):
            for s, (c, a) in list(now.items()):
                t = repair._NEXT[s]
                now[t] = min(now.get(t, (10 ** 9, "")), (c + 2, a + "I"))
        return now
    now = inserted({repair.START: (0, "")})
    for code in codes:
        after = {}
        for s, (c, a) in now.items():
            stays = 1 if code < 97 else 0
            steps = [(s, c + 3, a + "D")]
            if code != ord("d"):
                steps.append((repair._NEXT[s], c + 2 + stays, a + "R"))
                if repair._keeps(code, s):
                    steps.append((repair.SYSTEM if code | 32 == ord("s") else repair._NEXT[s], c + stays, a + "K"))
            for t, c2, a2 in steps:
                after[t] = min(after.get(t, (10 ** 9, "")), (c2, a2))
        now = inserted(after)
    return min(now[s] for s in (repair.START, repair.ASSISTANT) if s in now)


def test_search_on_longer_conversations():
    rnd = random.Random(6)
    for _ in range(400):
        codes = bytes(rnd.choice(b"suaxSUAXduaua") for _ in range(rnd.randint(6, 60)))
        assert repair.search(codes) == by_levels(codes)
    assert repair.search(b"d" * 20_000)[0] == 60_000
    assert repair.search(b"ua" * 20_000) == (0, "K" * 40_000)


def test_bounds_never_exceed_the_cost():
    rnd = random.Random(7)
    for _ in range(300):
        codes = bytes(rnd.choice(b"suaxSUAXd") for _ in range(rnd.randint(0, 9)))
        assert repair.suffix_bounds(codes)[0][repair.START] <= repair.search(codes)[0]


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        role = "user" if d == 4 else role
        out[conv] += [(turn, role, text)] * (2 if d == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def report(rows):
    out = []
    for conv, mine in damaged(rows).items():
        body = [(r, t) for _, r, t in mine]
        marks, turns = faults(body), {t for t, _, _ in mine if t is not None}
        cost, audit = by_levels(codes_of(body))
        text = "\n".join(f"{r}:{t}" for _, r, t in repair.apply_edits(body, audit))
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(body, body[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(k) for k in (
            "blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows],
                               "conv_id long, turn long, role string, text string, audit string, copy long")
    got = repair.damaged_and_repaired(df).collect()
    return sorted((tuple(r[c] for c in COLS) for r in got), key=lambda r: (r[0] is not None, r[0] or 0))


def test_against_plain_report(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, *range(9)]), rnd.choice(["user", "assistant", "system", None, "", "tool"]),
             rnd.choice(["Yes.", "Yes. ", "no", None, "", "\t\n", "é", "…", "Why?\x0b", "\xa0", "end. "])) for _ in range(400)]
    assert run(spark, rows) == report(rows)


def test_edges(spark):
    assert run(spark, []) == []
    gone = [(c, t, "user", "x.") for c in range(40) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    got = run(spark, gone)
    assert got == report(gone) and got[0][1:] == (0, 0, 0, 0, 0, 0, "", repair.EMPTY_SHA)
    long = [(1, t, "user" if t % 2 else "assistant", "w " * 50_000 + ("." if t % 3 else "")) for t in range(40)]
    assert run(spark, long) == report(long)
    copies = [(7, 1, "user", "again.")] * 300 + [(8, None, "assistant", "a.")] * 3
    assert run(spark, copies) == report(copies)


def test_small_table_and_sql(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in small("conversations")]
    assert run(spark, rows) == report(rows)
    got = queries.QUERIES["op12_repair"](spark, SMALL).toPandas()
    ok, why = compare(got, duck(queries.ORACLE_SQL["op12_repair"], SMALL))
    assert ok, why


def test_repaired_rows(spark):
    """String keys; the written rows are legal and give the digest."""
    rows = [("b", 0, "user", "Hi."), ("b", 1, "user", "Hi."), ("b", 2, "tool", "so"), ("a", 0, "system", "S."), ("a", 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    r = repair.Repair(df)
    audits = r.audits()
    found = {x["conv"]["id"]: (x["cost"], x["audit"]) for x in audits.collect()}
    assert found == {"a": (2, "KIK"), "b": (6, "KDR")}
    out = r.repaired(audits).orderBy("conv_id", "position").collect()
    assert [(x["conv_id"], x["edit"], x["role"], x["text"]) for x in out] == [
        ("a", "K", "system", "S."), ("a", "I", "user", ""), ("a", "K", "assistant", "Yes."),
        ("b", "K", "user", "Hi."), ("b", "R", "assistant", "so")]
    digests = {x["conv"]["id"]: x["repaired_sha256"] for x in r.digests(audits).collect()}
    assert digests["a"] == hashlib.sha256(b"system:S.\nuser:\nassistant:Yes.").hexdigest()


@pytest.mark.parametrize("text,fault", [("", "blank"), ("\xa0", "truncated"), ("a.\n", None), ("a. b", "truncated"), ("?", None)])
def test_faults(spark, text, fault):
    df = spark.createDataFrame([("c", 0, "user", text, 0)], "conv string, turn long, role string, text string, copy int")
    assert repair.with_faults(df).select(F.first("fault")).first()[0] == fault
