"""Benchmark decontamination under word edit distance (operator 9).

A text leaks an item when some passage of it is within ``(1 - similarity)``
of the item's length in word edits (insert, delete, replace).

1. *Windows.*  By the pigeonhole principle such a passage shares a run of
   ceil((m - e) / (e + 1)) words with the item (m words, e edits), so only
   item-sized windows around such runs are looked at: none is lost.
2. *CGK embedding.*  A random walk reads a window's words: at each step the
   current word is written and, by a random bit of (step, word), the walk moves
   on or stays.  Windows at a small edit distance get outputs at a small
   Hamming distance.
   Long items are cut into pieces: of the pieces of an item within its limit at
   least one is within its own, so agreement does not fall with the length.
3. *Bit-sampling LSH.*  Tables compare a few sampled steps of several walks;
   the number of tables follows, per length of a piece, from the target recall
   and the agreement measured at the limit for each kind of edit.
4. *Exact verification.*  Windows that collide are checked by the edit
   distance of the item to the best passage around them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.bpe import BoundedCache
from gradeflow.llm.common import mix64, rows, words_of

SIMILARITY = 0.8
TARGET_RECALL = 0.999
SAMPLED_STEPS = 2      # steps compared in a table
WALKS = 8
PIECE = 40             # words in a piece of an item at most
MEASURED_PAIRS = 400   # pairs drawn per kind of edit to measure the agreement
MEASURED_TABLES = 500  # tables drawn for each of them
KINDS = ("delete", "insert", "replace", "mixed")
ITEMS_PER_BLOCK = 20_000
_EDGE = b".,;:!?#*$%&|<>\"'()[]{}-_=+/\\~`^@"


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words without marks at their ends; words of marks alone go."""
    return [w for w in (x.strip(_EDGE) for x in words_of((text or "").lower())) if w]


def allowed_edits(m: int, similarity: float = SIMILARITY) -> int:
    return math.floor((1 - similarity) * m + 1e-9)


def shared_run(m: int, e: int) -> int:
    return max(1, math.ceil((m - e) / (e + 1)))


def edit(words: list, n: int, kind: str, rng: np.random.Generator, new) -> tuple[list, int, int]:
    """``n`` edits of one kind at random places (new words from ``new``), and
    the least and largest shift of a kept word against its place before."""
    out = [[w] for w in words]
    for p in rng.choice(len(words), n, replace=False):
        do = KINDS[rng.integers(3)] if kind == "mixed" else kind
        out[p] = [] if do == "delete" else [new()] if do == "replace" else [new(), words[p]]
    shifts, at = [0], 0
    for p, cell in enumerate(out):
        if cell and cell[-1] == words[p]:
            shifts.append(at + len(cell) - 1 - p)
        at += len(cell)
    return [w for cell in out for w in cell], min(shifts), max(shifts)


def walks(windows: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """[step, window, walk]: the words the walks read; -2 past the end."""
    n, m = windows.shape
    steps, line = 3 * m, np.arange(n)[:, None]
    padded = np.concatenate([windows, np.full((n, 1), -2)], 1)
    at, read = np.zeros((n, len(seeds)), np.int64), np.empty((steps, n, len(seeds)), np.int64)
    with np.errstate(over="ignore"):
        salt = np.uint64(0x9E3779B97F4A7C15) * padded.astype(np.uint64)
        for j in range(steps):
            read[j] = padded[line, at]
            bit = mix64(salt[line, at] + seeds * np.uint64(2 * j + 1)) & np.uint64(1)
            at = np.minimum(at + bit.astype(np.int64), m)
    return read


def hit_shares(m: int, e: int, kind: str, pairs: int = MEASURED_PAIRS, seed: int = 5) -> np.ndarray:
    """Per random pair with ``e`` edits of a kind: the share of tables in which
    one of the windows that every shared run brings up collides.  All words of
    a pair differ, so that nothing agrees by chance."""
    rng = np.random.default_rng([seed, m, e, KINDS.index(kind)])
    seeds = rng.integers(1, 1 << 62, WALKS).astype(np.uint64)
    out = np.empty(pairs)
    for k in range(pairs):
        words = rng.integers(0, 1 << 40, m)
        passage, low, high = edit(words.tolist(), e, kind, rng, lambda: int(rng.integers(1 << 40, 1 << 41)))
        doc = np.concatenate([np.full(2 * m, -1), passage, np.full(3 * m, -1)])
        first = np.arange(high - e, low + e + 1) if high - e <= low + e else np.zeros(1, np.int64)
        read = walks(np.concatenate([words[None, :], doc[2 * m + first[:, None] + np.arange(m)]]), seeds)
        same = (read[:, 1:] == read[:, :1]) & (read[:, :1] >= 0)
        walk = rng.integers(WALKS, size=MEASURED_TABLES)
        hit = np.ones((MEASURED_TABLES, len(first)), bool)
        for _ in range(SAMPLED_STEPS):
            hit &= same[rng.integers(3 * m, size=MEASURED_TABLES), :, walk]
        out[k] = hit.any(axis=1).mean()
    return out


@lru_cache(maxsize=None)
def tables_for(m: int, e: int, recall: float = TARGET_RECALL) -> int:
    """Tables with which pairs of ``m`` words and ``e`` edits are missed no more
    often than the recall allows, for the worst kind of edit."""
    most = 1
    for kind in KINDS if e else KINDS[:1]:
        q = np.minimum(hit_shares(m, e, kind), 1 - 1e-9)
        n = 1
        while np.mean((1 - q) ** n) > 1 - recall and n < 1 << 14:
            n = math.ceil(n * 1.1)
        most = max(most, n)
    return most


def pieces(m: int) -> list[tuple[int, int]]:
    """(first word, past the last word) of the pieces of an item of m words."""
    n = -(-m // PIECE)
    return [(m * k // n, m * (k + 1) // n) for k in range(n)]


class Items:
    """A bounded block of benchmark items, laid out for look-up."""

    def __init__(self, items: list[tuple[int, list[bytes]]], similarity: float = SIMILARITY,
                 recall: float = TARGET_RECALL, seed: int = 7):
        self.items = [(i, w) for i, w in items if w]
        self.vocab = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in self.items for w in ws))}
        self.words = [np.array([self.vocab[w] for w in ws], np.int64) for _, ws in self.items]
        self.edits = [allowed_edits(len(w), similarity) for w in self.words]
        self.pieces = [(k, a, b - a, allowed_edits(b - a, similarity))
                       for k, w in enumerate(self.words) for a, b in pieces(len(w))]
        self.grams: dict[int, dict[tuple, list[tuple[int, int]]]] = {}
        for x, (k, a, m, e) in enumerate(self.pieces):
            w, r = self.words[k][a:a + m], shared_run(m, e)
            for p in range(m - r + 1):
                self.grams.setdefault(r, {}).setdefault(tuple(w[p:p + r].tolist()), []).append((x, p))
        # sorted keys of the runs, looked up for all places of a text at once
        self.run_keys = {r: np.sort(run_keys(np.array([*g], np.int64).T)) for r, g in self.grams.items()}
        # edits weigh most in the shortest piece that allows them
        least: dict[int, int] = {}
        for m in range(1, PIECE + 1):
            least.setdefault(allowed_edits(m, similarity), m)
        self.n_tables = [tables_for(least[e], e, recall) for *_, e in self.pieces]
        rng = np.random.default_rng(seed)
        self.walk_seeds = rng.integers(1, 1 << 62, WALKS).astype(np.uint64)
        most = max(self.n_tables, default=1)
        self.table_walk, self.table_steps = rng.integers(WALKS, size=most), rng.random((most, SAMPLED_STEPS))
        self.codes = [self.code(self.words[k][None, a:a + m], n)
                      for (k, a, m, _), n in zip(self.pieces, self.n_tables)]

    def code(self, windows: np.ndarray, tables: int) -> np.ndarray:
        """[table, sampled step, window]: the words the walks read there."""
        read = walks(windows, self.walk_seeds)
        return read[(self.table_steps[:tables] * len(read)).astype(int), :, self.table_walk[:tables, None]]

    def find(self, doc: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item id, distance, first word, past the last word) of each leak in a
        text given as word numbers."""
        starts: dict[int, set[int]] = {}
        for r, grams in self.grams.items():
            n = len(doc) - r + 1
            if n < 1:
                continue
            keys, known = run_keys([doc[i:i + n] for i in range(r)]), self.run_keys[r]
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            for q in np.flatnonzero(known[at] == keys).tolist():
                for k, p in grams.get(tuple(doc[q:q + r].tolist()), ()):
                    starts.setdefault(k, set()).add(q - p)
        near: dict[int, list[np.ndarray]] = {}
        for x, seeds in starts.items():
            k, a, m, e = self.pieces[x]
            # piece-sized windows at every shift that e edits allow
            at = np.unique(np.add.outer(np.array(sorted(seeds)), np.arange(-e, e + 1)))
            at = at[(at > -m) & (at < len(doc))]
            for part in np.array_split(at, max(1, -(-len(at) // 512))):
                pos = part[:, None] + np.arange(m)
                inside = (pos >= 0) & (pos < len(doc))
                # words beyond the text's ends and words no item has can't agree
                windows = np.where(inside, doc[np.clip(pos, 0, len(doc) - 1)], -3)
                same = (self.code(windows, self.n_tables[x]) == self.codes[x]) & (self.codes[x] >= 0)
                hits = part[same.all(axis=1).any(axis=0)]
                # where a whole item may begin and end around the window
                reach = self.edits[k] + e
                near.setdefault(k, []).append(np.stack([hits - a - reach, hits - a + len(self.words[k]) + reach], 1))
        for k, spans in near.items():
            m, e = len(self.words[k]), self.edits[k]
            best = None
            for low, high in joined(np.concatenate(spans), len(doc)):
                d, end = best_passage(self.words[k], doc[low:high])
                if d <= e and (best is None or d < best[0]):
                    best = (d, low, low + end)
                    if d == 0:
                        break
            if best:
                # the same edits read backwards from the passage's end lead to its first word
                _, length = best_passage(self.words[k][::-1], doc[best[1]:best[2]][::-1], anchored=True)
                yield self.items[k][0], best[0], best[2] - length, best[2]


def joined(spans: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Spans within 0..n, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for low, high in np.clip(np.unique(spans, axis=0), 0, n).tolist():
        if out and low < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        elif low < high:
            out.append((low, high))
    return out


def run_keys(words) -> np.ndarray:
    """One key per run from its words' numbers (equal runs, equal keys; hits
    are looked up exactly)."""
    key = np.zeros(len(words[0]), np.uint64)
    with np.errstate(over="ignore"):
        for w in words:
            key = key * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64)
    return key


def best_passage(item: np.ndarray, text: np.ndarray, anchored: bool = False) -> tuple[int, int]:
    """Least word edits between the item and any passage (``anchored``: any that begins with the text), and its
    end: rows of the alignment table, insertions resolved by a running minimum."""
    j = np.arange(len(text) + 1)
    row = j.astype(np.int64) if anchored else np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item, 1):
        nxt = np.empty_like(row)
        nxt[0] = i
        nxt[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(nxt - j) + j
    end = int(row.argmin())
    return int(row[end]), end


def leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
          item_key: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY,
          recall: float = TARGET_RECALL, pass_through: bool = False) -> DataFrame:
    """(key, item, distance, first_word, end_word) for each leaked item of a text.

    Null and empty texts, and items without words, match nothing; an item too
    short for an edit must occur as it is.  Repeated rows and repeated items
    each give their rows.  The benchmark is read in blocks of a fixed number of
    items, each sent to the tasks.  With ``pass_through`` the rows of ``df``
    that leak nothing come back instead, columns as they are."""
    items = benchmark.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    blocks = max(1, -(-items.count() // ITEMS_PER_BLOCK))
    block_of = F.pmod(F.xxhash64("t"), F.lit(blocks))
    item_kind = items.schema["i"].dataType
    out, clean = None, df
    for n in range(blocks):
        block = Items([(r["i"], normal_words(r["t"])) for r in items.where(block_of == n).orderBy("i", "t").collect()],
                      similarity, recall)
        if pass_through:
            clean = _apply(clean, block, key, text, True, item_kind)
        else:
            part = _apply(df.select(F.col(key).alias("k"), F.col(text).alias("t")), block, "k", "t", False, item_kind)
            out = part if out is None else out.unionByName(part)
    return clean if pass_through else out.withColumnsRenamed({"k": key, "item": item_key})


def _apply(df: DataFrame, block: Items, key: str, text: str, pass_through: bool, item_kind) -> DataFrame:
    def searcher():
        get = block.vocab.get
        # -1: a word no item has; marks at a word's ends do not count; -9: no word
        def ident(w: bytes) -> int:
            x = (w if w.isascii() else w.decode().lower().encode()).strip(_EDGE)
            return get(x, -1) if x else -9
        ids = BoundedCache(ident)

        def search(t):
            if not block.items:
                return []
            words = words_of(t)
            doc = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
            return [*block.find(doc[doc != -9])]
        return search

    if pass_through:
        def keep(batches):
            search = searcher()
            for b in batches:
                ok = [not search(t) for t in b.column(text).to_pylist()]
                yield b.filter(pa.array(ok, pa.bool_()))
        return df.mapInArrow(keep, df.schema)

    def run(batches):
        search = searcher()
        for ks, ts in rows(batches, key, text):
            found = [(k, *x) for k, t in zip(ks, ts) for x in search(t)]
            yield pa.RecordBatch.from_pydict({
                "k": pa.array([f[0] for f in found], key_arrow), "item": pa.array([f[1] for f in found], item_arrow),
                "distance": pa.array([f[2] for f in found], pa.int32()),
                "first_word": pa.array([f[3] for f in found], pa.int32()),
                "end_word": pa.array([f[4] for f in found], pa.int32())})

    kind = df.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    key_arrow, item_arrow = to_arrow_type(kind), to_arrow_type(item_kind)
    return df.mapInArrow(run, f"k {kind.simpleString()}, item {item_kind.simpleString()}, distance int, first_word int, end_word int")
