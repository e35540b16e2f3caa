"""Exact removal of repeated byte strings by a distributed suffix merge (operator 1).

A byte goes when some string of ``LENGTH`` bytes that covers it also starts
earlier (smaller document, or earlier in the same one).

1. *Copies.*  Texts that are equal as a whole collapse to their first document.
2. *Candidates.*  Every window of LENGTH bytes has an anchor, the smallest of
   its K-byte grams by hash (leftmost of equals); equal windows have it at the
   same place.  Only anchors whose gram occurs twice can lie in a repeat.
3. *Runs.*  Each task cuts the suffixes that start up to OFFSETS bytes before
   such anchors, drops those it has seen (the first stays, the rest are
   repeats), sorts them and sends front-coded runs: the length of the prefix
   shared with the suffix before, and the rest.
4. *Merge.*  A loser tree keeps, for each run's head, the prefix it shares with
   the last output; heads that differ there are ordered without looking at
   their bytes, others are compared from the known prefix on.  The merge gives
   the suffix order with common-prefix lengths, in which equal windows are
   neighbours; all but the first are repeats.

A suffix and the up to STRIDE - 1 bytes before it stand for STRIDE windows.
Suffixes are dealt by the bytes all these windows share.  Grams that occur
more than HOT times are dealt window by window, by all of a window's bytes, so
that a common line doesn't bring the texts around it together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import mix64, rows, spread

LENGTH = 100
STRIDE = 17
K = LENGTH - 4 * STRIDE + 1             # 33
GRAMS = LENGTH - K + 1                  # grams in a window: 68 = 4 * STRIDE
SHARED = LENGTH - STRIDE + 1            # bytes that all windows of a suffix share
HOT = 20_000
SLICE = 1 << 22                         # windows hashed at a time
BUFFER = 64 << 20                       # compressed bytes a task holds back
RUN_ITEMS = 400_000                     # suffixes in a run
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    step = np.uint64(base)
    with np.errstate(over="ignore"):
        if n > 1:
            np.multiply.accumulate(np.full(n - 1, step, np.uint64), out=out[1:])
    return out


class Anchors:
    """Anchors of a text: hash, position, first and last window start."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def grams(self, data: np.ndarray) -> np.ndarray:
        """Hash of every K-byte gram by differences of a running sum."""
        if len(self.up) < len(data) + 1:
            n = 1 << len(data).bit_length()
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        n = len(data)
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
            return mix64((total[K:] - total[:n - K + 1]) * self.down[:n - K + 1])

    def of(self, data: np.ndarray, windows: np.ndarray | None = None):
        """(hash, position, first start, last start) of the anchors of all
        windows (or those marked); one text, or several side by side."""
        h = self.grams(data)
        bits = np.uint64(23)
        key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= GRAMS:
            key = np.minimum(key[:len(key) - size], key[size:])
            size *= 2
        if GRAMS > size:
            key = np.minimum(key[:len(key) - (GRAMS - size)], key[GRAMS - size:])
        at = (key & np.uint64((1 << 23) - 1)).astype(np.int64)
        start = np.arange(len(at))
        if windows is not None:
            start = start[windows[:len(at)]]
            at = at[start]
        if not len(at):
            z = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), z, z, z
        cut = np.flatnonzero((at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(at)]]) - 1
        return h[at[first]], at[first], start[first], start[last]


def _distinct_texts(src: DataFrame, parts: int) -> DataFrame:
    """(rid, sha, doc, z) per distinct text of LENGTH bytes or more: the first
    eight bytes of its SHA-256, the hash, its first document, its bytes
    compressed.  Tasks collapse copies before the shuffle."""
    def run(batches):
        held: dict[bytes, list] = {}
        size = 0
        pack = zstandard.ZstdCompressor(level=3)

        def out():
            b = pa.RecordBatch.from_pydict({
                "rid": pa.array([int.from_bytes(s[:8], "big", signed=True) for s in held], pa.int64()),
                "sha": pa.array([*held.keys()], pa.binary()),
                "doc": pa.array([v[0] for v in held.values()], pa.int64()),
                "z": pa.array([v[1] for v in held.values()], pa.binary())})
            held.clear()
            return b

        for docs, texts in rows(batches, "doc", "t"):
            for d, t in zip(docs, texts):
                raw = t.encode()
                if len(raw) < LENGTH:
                    continue
                s = hashlib.sha256(raw).digest()
                if s in held:
                    held[s][0] = min(held[s][0], d)
                else:
                    held[s] = [d, pack.compress(raw)]
                    size += len(held[s][1])
            if size > BUFFER:
                yield out()
                size = 0
        if held:
            yield out()

    # the filter is there for joins on rid to find it: none adds its own below
    # the shuffle, which all three uses of this frame then share
    return (src.mapInArrow(run, "rid long, sha binary, doc long, z binary").where("rid IS NOT NULL")
            .repartition(parts, "rid")
            .groupBy("rid", "sha").agg(F.min("doc").alias("doc"), F.first("z").alias("z")))


def _anchor_rows(batches):
    """(h, rid, place): place packs position, position - first start and last
    start - first start of each anchor."""
    find, unpack = Anchors(), zstandard.ZstdDecompressor()

    def out(h, rid, at, first, last):
        place = at << 16 | (at - first) << 8 | (last - first)
        return pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "rid": pa.array(rid), "place": pa.array(place)})

    for rids, zs in rows(batches, "rid", "z"):
        texts = [np.frombuffer(unpack.decompress(z), np.uint8) for z in zs]
        i = 0
        while i < len(texts):
            # short texts side by side, a long one in slices that overlap
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE):
                size += len(texts[j])
                j += 1
            if j == i + 1:
                for at in range(0, len(texts[i]) - LENGTH + 1, SLICE):
                    h, a, f, l_ = find.of(texts[i][at:at + SLICE + LENGTH - 1])
                    yield out(h, np.full(len(h), rids[i], np.int64), a + at, f + at, l_ + at)
            else:
                lens = np.array([len(x) for x in texts[i:j]])
                ends = np.cumsum(lens)
                ok = np.ones(size, bool)
                for e in ends.tolist():
                    ok[e - LENGTH + 1:e] = False
                h, a, f, l_ = find.of(np.concatenate(texts[i:j]), ok)
                which = np.searchsorted(ends, f, side="right")
                base = (ends - lens)[which]
                yield out(h, np.array(rids[i:j], np.int64)[which], a - base, f - base, l_ - base)
            i = j


# -- runs ------------------------------------------------------------------------
def encode_run(items: list[tuple]) -> bytes:
    """Front-coded run of sorted items (suffix, left, jlo, jhi, doc, rid, start)."""
    n = len(items)
    lens = np.array([len(x[0]) for x in items], np.uint8)
    wide = np.frombuffer(b"".join(x[0].ljust(LENGTH + 1, b"\0") for x in items), np.uint8).reshape(n, LENGTH + 1)
    lcp = np.zeros(n, np.uint8)
    if n > 1:
        differ = wide[1:] != wide[:-1]
        lcp[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), LENGTH + 1), np.minimum(lens[1:], lens[:-1]))
    rest = b"".join(x[0][k:] for x, k in zip(items, lcp.tolist()))
    cols = [lcp.tobytes(), lens.tobytes(), b"".join(x[1] for x in items),
            bytes(x[2] for x in items), bytes(x[3] for x in items),
            np.array([x[4] for x in items], "<i8").tobytes(), np.array([x[5] for x in items], "<i8").tobytes(),
            np.array([x[6] for x in items], "<i8").tobytes(), rest]
    return zstandard.compress(n.to_bytes(8, "little") + b"".join(cols), 3)


def decode_run(blob: bytes):
    raw = zstandard.decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for size in (n, n, 16 * n, n, n, 8 * n, 8 * n, 8 * n):
        out.append(raw[at:at + size])
        at += size
    suffixes, last = [], b""
    for k, m in zip(out[0], out[1]):
        last = last[:k] + raw[at:at + m - k]
        at += m - k
        suffixes.append(last)
    left = np.frombuffer(out[2], ">u8").reshape(n, 2).astype(np.uint64)
    doc, rid, start = (np.frombuffer(x, "<i8") for x in out[5:8])
    return suffixes, out[0], left, np.frombuffer(out[3], np.uint8), np.frombuffer(out[4], np.uint8), doc, rid, start


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, ``known`` bytes of which are not looked at."""
    n = min(len(a), len(b))
    while known < n:
        x, y = a[known:known + 16], b[known:known + 16]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return known + m - (d.bit_length() + 7) // 8
        known += len(x)
    return n


def merge_runs(runs: list[tuple[list[bytes], bytes]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs with a loser tree that knows common prefixes.

    ``runs`` are (strings, prefix shared with the string before in the run).
    Returns the run of each output string and the prefix it shares with the
    output before.  Of equal strings, the earlier run's comes first.

    A head's ``known`` is its common prefix with the last output.  The head that
    shares more is the smaller one; only equal values need bytes, read from
    there on; the loser then keeps its common prefix with the winner, which is
    the last output by the time it is looked at again."""
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    shared = [r[1] for r in runs] + [b""] * (k - len(runs))
    head: list[bytes | None] = [s[0] if s else None for s in strings]
    known, place, total = [0] * k, [0] * k, sum(map(len, strings))
    lose = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] > known[b]:
            return a, b
        if known[a] < known[b]:
            return b, a
        n = common_prefix(x, y, known[a])
        if n == len(x) and (n < len(y) or a < b) or n < len(x) and n < len(y) and x[n] < y[n]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        nxt = []
        for i in range(0, len(level), 2):
            w, loser = play(level[i], level[i + 1])
            lose[node + i // 2] = loser
            nxt.append(w)
        level = nxt
    win, of, lcp = level[0], [0] * total, [0] * total
    for out in range(total):
        of[out], lcp[out] = win, known[win]
        place[win] += 1
        p = place[win]
        if p < len(strings[win]):
            head[win], known[win] = strings[win][p], shared[win][p]
        else:
            head[win] = None
        node = (win + k) // 2
        while node:
            b = lose[node]
            y = head[b]
            if y is not None:
                x = head[win]
                if x is None or known[b] > known[win]:
                    lose[node], win = win, b
                elif known[b] == known[win]:
                    w, loser = play(win, b)
                    lose[node], win = loser, w
            node //= 2
    if total:
        lcp[0] = 0
    return of, lcp


def repeated(lcp: np.ndarray, left: np.ndarray, jlo: np.ndarray, jhi: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bit j of an item: its window j bytes before the suffix is not the first
    of its kind.  ``order`` ranks the items by where they start."""
    n, out = len(lcp), np.zeros(len(lcp), np.int32)
    near = np.zeros(n, bool)
    close = lcp[1:] >= SHARED + 1
    near[1:] |= close
    near[:-1] |= close
    # several windows of one text can share an item's bytes with another item:
    # the start within the text differs by j, the rank of equal j does not
    for j in range(STRIDE):
        group = np.cumsum(lcp < LENGTH + 1 - j)
        idx = np.flatnonzero(near & (jlo <= j) & (jhi >= j))
        if len(idx) < 2:
            continue
        hi = np.uint64(0) if j == 0 else np.uint64(((1 << 64) - 1) ^ ((1 << (64 - 8 * min(j, 8))) - 1))
        lo = np.uint64(0) if j <= 8 else np.uint64(((1 << 64) - 1) ^ ((1 << (64 - 8 * (j - 8))) - 1))
        a, b, g = left[idx, 0] & hi, left[idx, 1] & lo, group[idx]
        s = np.lexsort((order[idx], b, a, g))
        a, b, g = a[s], b[s], g[s]
        same = (g[1:] == g[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        out[idx[s[1:][same]]] |= 1 << j
    return out


def _make_runs(deal: int):
    """(r, run, done): a task's sorted runs, and the windows it found repeated
    itself as packed (doc, rid, start, bits)."""
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        items: list[dict[tuple, list]] = [{} for _ in range(deal)]
        done: list[list] = [[] for _ in range(deal)]
        size = 0

        def put(suffix, left, jlo, jhi, doc, rid, start, shared_bytes):
            r = xxhash.xxh3_64_intdigest(shared_bytes) % deal
            key, place = (suffix, left, jlo, jhi), (doc, rid, start)
            seen = items[r].get(key)
            if seen is None:
                items[r][key] = place
                return 1
            first, later = (seen, place) if seen < place else (place, seen)
            items[r][key] = first
            done[r].append((*later, (1 << (jhi + 1)) - (1 << jlo)))
            return 0

        def flush():
            for r in range(deal):
                if items[r] or done[r]:
                    ordered = sorted((k + v for k, v in items[r].items()))
                    yield pa.RecordBatch.from_pydict({
                        "r": pa.array([r], pa.int32()),
                        "run": pa.array([encode_run(ordered) if ordered else b""], pa.binary()),
                        "done": pa.array([np.array(done[r], "<i8").tobytes()], pa.binary())})
                    items[r], done[r] = {}, []

        for docs, rids, zs, places in rows(batches, "doc", "rid", "z", "places"):
            for doc, rid, z, ps in zip(docs, rids, zs, places):
                text = unpack.decompress(z)
                n = len(text)
                for p in sorted(ps):
                    p, hot = p >> 1, p & 1
                    at, most, spread_ = p >> 16, p >> 8 & 255, p & 255
                    if at + K > n:
                        continue
                    least = most - spread_      # anchor offsets in its windows
                    for b in range(least // STRIDE, most // STRIDE + 1):
                        start = at - b * STRIDE
                        jlo, jhi = max(least - b * STRIDE, 0), min(most - b * STRIDE, STRIDE - 1)
                        mark = b"%c" % b
                        if not hot:
                            suffix = mark + text[start:start + LENGTH - jlo]
                            left = text[start - jhi:start][::-1].ljust(16, b"\0")
                            size += put(suffix, left, jlo, jhi, doc, rid, start, suffix[:SHARED + 1])
                            continue
                        for j in range(jlo, jhi + 1):
                            suffix = mark + text[start:start + LENGTH - j]
                            left = text[start - j:start][::-1].ljust(16, b"\0")
                            size += put(suffix, left, j, j, doc, rid, start, suffix + left)
                if size > RUN_ITEMS:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _merge(t: pa.Table) -> pa.Table:
    """Merge the runs of one deal; (rid, doc, start, bits) of repeated windows."""
    runs = [decode_run(x) for x in t["run"].to_pylist() if x]
    done = [np.frombuffer(x, "<i8").reshape(-1, 4) for x in t["done"].to_pylist() if x]
    found = [np.concatenate(done)] if done else []
    if runs:
        of, lcp = merge_runs([(r[0], r[1]) for r in runs])
        of = np.array(of)
        # output order: run by run, places ascend
        take = np.empty(len(of), np.int64)
        base = np.cumsum([0] + [len(r[0]) for r in runs])
        for k in range(len(runs)):
            here = np.flatnonzero(of == k)
            take[here] = base[k] + np.arange(len(here))
        left, jlo, jhi, doc, rid, start = (np.concatenate([r[c] for r in runs])[take] for c in range(2, 8))
        rank = np.empty(len(of), np.int64)
        rank[np.lexsort((start, rid, doc))] = np.arange(len(of))
        bits = repeated(np.array(lcp, np.int32), left, jlo, jhi, rank)
        hit = bits > 0
        found.append(np.stack([doc[hit], rid[hit], start[hit], bits[hit].astype(np.int64)], 1))
    all_ = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    return pa.table({"rid": all_[:, 1], "doc": all_[:, 0], "start": all_[:, 2], "bits": all_[:, 3].astype(np.int32)})


def _cut_out(batches):
    """Removed byte counts and the hash of what is left, per distinct text."""
    unpack = zstandard.ZstdDecompressor()
    offsets = np.arange(STRIDE)
    for docs, shas, zs, hits in rows(batches, "doc", "sha", "z", "hits"):
        out = []
        for doc, z, hit in zip(docs, zs, hits):
            raw = np.frombuffer(unpack.decompress(z), np.uint8)
            own = [(h["start"], h["bits"]) for h in hit or () if h["doc"] == doc]
            step = np.zeros(len(raw) + 1, np.int32)
            if own:
                s, b = np.array(own, np.int64).T
                on = (b[:, None] >> offsets) & 1 == 1
                first = (s[:, None] - offsets)[on]
                np.add.at(step, first, 1)
                np.add.at(step, first + LENGTH, -1)
            gone = np.cumsum(step[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
        yield pa.RecordBatch.from_pydict({
            "doc": pa.array(docs, pa.int64()), "sha": pa.array(shas, pa.binary()),
            "n_removed": pa.array([o[0] for o in out], pa.int64()), "n_spans": pa.array([o[1] for o in out], pa.int64()),
            "kept_sha256": pa.array([o[2] for o in out], pa.string())})


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256: one row per input row.

    Null texts are empty; texts of fewer than LENGTH bytes lose nothing.  Keys
    are integers; a null key comes before all others; texts that share a key
    come in the order of their hash; of rows that repeat, one is the first and
    the rest are copies of it.  An empty table gives an empty result."""
    parts = spread(df)
    lowest = F.lit(-(1 << 63)).cast("long")
    src = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    texts = _distinct_texts(src.select(F.coalesce("key", lowest).alias("doc"), "t"), parts)
    # tasks take all columns of the texts, so that the shuffle is the same one
    anchors = texts.mapInArrow(_anchor_rows, "h long, rid long, place long")
    # a gram has one small row per window group here: even one in every text is
    # a small share of all anchors
    twice = anchors.selectExpr("rid", "place", "count(*) OVER (PARTITION BY h) AS n").where("n > 1")
    candidates = twice.groupBy(F.col("rid").alias("c_rid")).agg(
        F.collect_list(F.shiftleft("place", 1) + (F.col("n") > hot).cast("long")).alias("places"))
    runs = (texts.join(candidates, F.col("rid") == F.col("c_rid"))
            .mapInArrow(_make_runs(2 * parts), "r int, run binary, done binary"))
    repeats = runs.groupBy("r").applyInArrow(_merge, "rid long, doc long, start long, bits int")
    hits = repeats.groupBy(F.col("rid").alias("h_rid")).agg(F.collect_list(F.struct("doc", "start", "bits")).alias("hits"))
    firsts = (texts.join(hits, F.col("rid") == F.col("h_rid"), "left")
              .mapInArrow(_cut_out, "doc long, sha binary, n_removed long, n_spans long, kept_sha256 string"))
    firsts = firsts.withColumnsRenamed({"doc": "f_doc", "sha": "f_sha"})
    every = src.select("key", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("hex")).groupBy(
        "key", "hex").agg(F.first("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
    j = every.join(firsts, (F.coalesce("key", lowest) == F.col("f_doc")) & (F.unhex("hex") == F.col("f_sha")), "left")
    j = j.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    first = F.col("f_sha").isNotNull() & (F.col("copy") == 1)
    whole = F.col("n_bytes") >= LENGTH

    def either(of_first, of_copy, of_short):
        return F.when(first, of_first).when(whole, of_copy).otherwise(of_short)

    zero = F.lit(0).cast("long")
    return j.select(F.col("key").alias(key), "n_bytes", either(F.col("n_removed"), F.col("n_bytes"), zero).alias("n_removed"),
                    either(F.col("n_spans"), F.lit(1).cast("long"), zero).alias("n_spans"),
                    either(F.col("kept_sha256"), F.lit(EMPTY_SHA), F.col("hex")).alias("kept_sha256"))
