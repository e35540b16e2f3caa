"""Conversation structure repair (operator 12).

A conversation should read ``(s?(ua)+)?`` in the initials of its roles, without blank
or repeated rows.  The cheapest edits (keep, rerole, delete, insert) are found by
depth-first branch and bound over nodes (rows read, role last written): an explicit stack,
a lower bound on what the remaining rows cost, an incumbent (cost, audit) and, per node, the
least cost at which it was reached.  Branches are taken in ASCII order of their initials, so
prefixes arrive in ASCII order and, of two prefixes of equal cost at one node, the later
one is never better.

Only compact codes (one byte a row) are searched.  Texts are read twice by Spark, each time
sorted by conversation and turn, and streamed: to tell faults apart, and to write the repaired
rows into a hash (or out) under the audit.  No task holds a conversation's texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.llm.common import cut

# Costs of the edits, in ASCII order of their initials, and of a truncated row that stays.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 3, 2, 0, 2, 1

#: What was written last: nothing, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant row is written (only one of both fits).
_NEXT = (USER, USER, ASSISTANT, USER)
_ENDS = (START, ASSISTANT)

BLANK = r"[^\x20\x09-\x0D]"
GAP = r"\x20\x09-\x0D"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _keeps(code: int, state: int) -> bool:
    """Whether a row's own role may follow ``state``.  A code is a letter of its role
    (s, u, a, or x for any other), upper case if the row is truncated; d must be deleted."""
    letter = code | 32
    return letter == 115 and state == START or letter == (117, 117, 97, 117)[state]


def suffix_bounds(codes: bytes) -> list[tuple[int, int, int, int]]:
    """bounds[i][state]: a lower bound on the cost of rows i and on, from a relaxed problem
    in which the conversation may end after any row and at most one row is inserted before each.

    The first relaxation only lowers the cost; the second changes nothing, since a second insertion
    in one place restores the role at a cost above deleting the row."""
    bounds = [(0, 0, 0, 0)]
    for code in reversed(codes):
        after = bounds[-1]
        plain = []
        for state in range(4):
            least = after[state] + DELETE
            if code != 100:
                stays = TRUNCATED if code < 97 else 0
                least = min(least, after[_NEXT[state]] + REROLE + stays)
                if _keeps(code, state):
                    least = min(least, after[SYSTEM if code | 32 == 115 else _NEXT[state]] + stays)
            plain.append(least)
        bounds.append(tuple(min(plain[s], INSERT + plain[_NEXT[s]]) for s in range(4)))
    return bounds[::-1]


def _branches(codes: bytes, i: int, state: int) -> list[tuple[int, int, int, int]]:
    """(initial, rows read, state, cost) of the edits possible at a node, in ASCII order."""
    out = []
    code = codes[i] if i < len(codes) else None
    if code is not None:
        out.append((68, i + 1, state, DELETE))
    out.append((73, i, _NEXT[state], INSERT))
    if code is not None and code != 100:
        stays = TRUNCATED if code < 97 else 0
        if _keeps(code, state):
            out.append((75, i + 1, SYSTEM if code | 32 == 115 else _NEXT[state], KEEP + stays))
        out.append((82, i + 1, _NEXT[state], REROLE + stays))
    return out


def search(codes: bytes) -> tuple[int, str]:
    """The least cost and the ASCII-least audit of that cost."""
    n, bounds = len(codes), suffix_bounds(codes)
    # a first incumbent: always the branch of the least bound
    i, state, cost, best_audit = 0, START, 0, bytearray()
    while i < n or state not in _ENDS:
        at, i, state, step = min(_branches(codes, i, state), key=lambda b: (b[3] + bounds[b[1]][b[2]], b[1] == i))
        cost += step
        best_audit.append(at)
    best, best_audit = cost, bytes(best_audit)
    least = [4 * (DELETE * n + INSERT + 1)] * (4 * (n + 1))  # dominance: the least cost seen per node
    path = bytearray()
    stack = [(0, 0, START, 0, 0)]  # depth, rows read, state, cost, initial
    while stack:
        depth, i, state, cost, at = stack.pop()
        if cost + bounds[i][state] > best or cost >= least[4 * i + state]:
            continue
        least[4 * i + state] = cost
        if depth:
            del path[depth - 1:]
            path.append(at)
        if i == n and state in _ENDS and (cost < best or cost == best and bytes(path) < best_audit):
            best, best_audit = cost, bytes(path)
        for initial, j, to, step in reversed(_branches(codes, i, state)):
            if cost + step + bounds[j][to] <= best and cost + step < least[4 * j + to]:
                stack.append((depth + 1, j, to, cost + step, initial))
    return best, best_audit.decode()


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, copy) with ``code`` (see ``_keeps``), the first ``fault`` of each
    (blank, duplicate, truncated or null) and the ``initial`` of its role.

    Duplicates are found by role and text themselves; rows are in order of turn (nulls first), then
    role, text and copy."""
    order = [F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    first = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(*order)) == 1
    fault = (F.when(~F.col("text").rlike(BLANK), "blank").when(~first, "duplicate")
              .when(~F.col("text").rlike(rf"[.!?][{GAP}]*\z"), "truncated"))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault").isNotNull(), F.upper(letter)).otherwise(letter)
    return rows.withColumn("fault", fault).withColumn("initial", initial).withColumn("code", code)


def _audits(conv_type: pa.DataType):
    schema = pa.schema([("conv", conv_type), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()),
                        ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, key, known, last, illegal, found = bytearray(), None, False, None, 0, [0, 0, 0]
        kind = {"blank": 0, "duplicate": 1, "truncated": 2}

        def closed():
            return (key, *search(bytes(codes)), illegal, *found)

        for batch in batches:
            out = []
            for conv, code, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "code", "initial", "fault"))):
                if not known or conv != key:
                    if known:
                        out.append(closed())
                    codes, key, known, last, illegal, found = bytearray(), conv, True, None, 0, [0, 0, 0]
                codes += code.encode()
                illegal += last is not None and last + initial not in ("su", "ua", "au")
                last = initial
                if fault:
                    found[kind[fault]] += 1
            yield from _rows(out, schema)
        if known:
            yield from _rows([closed()], schema)
    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_ROLE = {USER: "user", ASSISTANT: "assistant"}


def apply_edits(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired rows, read as they come."""
    rows, state = iter(rows), START
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            yield edit, _ROLE[state], ""
            continue
        role, text = next(rows)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            state = SYSTEM
        else:
            state = _NEXT[state]
        yield edit, role if edit == "K" else _ROLE[state], text


def _each_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, Iterator[tuple[str, str]]]]:
    """(conv, audit, rows) per conversation of a sorted stream, whose first row holds the audit
    (it is null in the others); rows must be read before the next conversation is asked for."""
    stream = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv", "audit", "role", "text"))))
    ahead = next(stream, None)
    while ahead is not None:
        conv, audit = ahead[:2]

        def rows():
            nonlocal ahead
            for row in stream:
                if row[1] is not None:
                    ahead = row
                    return
                yield row[2:]
            ahead = None
        mine = rows()
        yield conv, audit, mine
        for _ in mine:
            pass


def _digests(conv_type: pa.DataType):
    schema = pa.schema([("conv", conv_type), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, audit, rows in _each_conversation(batches):
            state, sep = hashlib.sha256(), b""
            for _, role, text in apply_edits(rows, audit):
                state.update(sep + role.encode() + b":" + text.encode())
                sep = b"\n"
            out.append((conv, state.hexdigest()))
            if len(out) == 1000:
                yield from _rows(out, schema)
                out = []
        yield from _rows(out, schema)
    return run


def _written(conv_type: pa.DataType):
    schema = pa.schema([("conv", conv_type), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                        ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, audit, rows in _each_conversation(batches):
            out = []
            for i, (edit, role, text) in enumerate(apply_edits(rows, audit)):
                out.append((conv, i, edit, role, text))
                if len(out) == 100:
                    yield from _rows(out, schema)
                    out = []
            yield from _rows(out, schema)
    return run


class Repair:
    """The repair of a table of rows (conv_id, turn, role, text; ``copy`` orders rows that are otherwise equal).

    A null conv_id is a conversation of its own; null roles and texts must be filled before.  A role without
    an initial s, u or a (the empty one too) can only be reroled or deleted.  Other columns are ignored."""

    def __init__(self, rows: DataFrame):
        if "copy" not in rows.columns:
            rows = rows.withColumn("copy", F.lit(0))
        kind = rows.schema["conv_id"].dataType
        # a struct, so that a null conv_id groups and joins like any other
        self.conv = f"struct<id:{kind.simpleString()},none:boolean>"
        self.arrow = pa.struct([("id", _arrow_type(kind)), ("none", pa.bool_())])
        self.rows = rows.select(F.struct(F.col("conv_id").alias("id"), F.col("conv_id").isNull().alias("none")).alias("conv"),
                                "turn", "role", "text", "copy")
        self.order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "copy"]

    def audits(self) -> DataFrame:
        """conv, cost, audit, illegal and the numbers of each first fault: conversations with rows only."""
        dealt = self.rows.repartition("conv")
        ordered = with_faults(dealt).sortWithinPartitions(*self.order).select("conv", "code", "initial", "fault")
        return cut(ordered.mapInArrow(_audits(self.arrow), f"conv {self.conv}, cost long, audit string, illegal long, "
                                                           "blank long, duplicate long, truncated long"))

    def _beside(self, audits: DataFrame) -> DataFrame:
        """All rows in order, each conversation opened by a row with its audit: one shuffle of the texts, no join."""
        opening = audits.select("conv", F.lit(None).cast(self.rows.schema["turn"].dataType).alias("turn"),
                                F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copy"), "audit")
        both = self.rows.withColumn("audit", F.lit(None).cast("string")).unionByName(opening)
        return both.repartition("conv").sortWithinPartitions("conv", F.col("audit").asc_nulls_last(), *self.order[1:]) \
            .select("conv", "audit", "role", "text")

    def digests(self, audits: DataFrame) -> DataFrame:
        return self._beside(audits).mapInArrow(_digests(self.arrow), f"conv {self.conv}, repaired_sha256 string")

    def repaired(self, audits: DataFrame) -> DataFrame:
        """The repaired rows: conv_id, position, edit (K, R or I), role, text."""
        out = self._beside(audits).mapInArrow(
            _written(self.arrow), f"conv {self.conv}, position long, edit string, role string, text string")
        return out.select(F.col("conv.id").alias("conv_id"), "position", "edit", "role", "text")


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32("conv_id:turn") % 20: 0 gone, 1 without text, 2 without ``.!?``, 3 twice
    (``copy`` 0 and 1), 4 by the user.  Nulls are one space (in the hashed text too); a null turn stays null
    where rows are ordered."""
    def filled(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), d.alias("d"))
    return rows.where("d <> 0").select(
        "conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def repair_report(original: DataFrame, rows: DataFrame) -> DataFrame:
    """Per conv_id of ``original``: gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of its rows in ``rows``; without any: zeros, an empty audit and the hash of nothing.
    Repeated rows are rows of their own; an empty table gives no rows."""
    r = Repair(rows)
    audits = r.audits()
    turns = r.rows.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n"))
    gaps = turns.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    convs = original.select(F.struct(F.col("conv_id").alias("id"), F.col("conv_id").isNull().alias("none")).alias("conv")).distinct()
    out = convs.join(gaps, "conv", "left").join(audits, "conv", "left").join(r.digests(audits), "conv", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv.id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    return repair_report(conversations, damage(conversations))
