"""Byte-level BPE encoding and decoding (operator 3).

Text is cut by the vocabulary's split pattern; each piece is merged pair by
pair.  A piece longer than ``LEAF`` bytes is encoded by *tree concatenation*:
halves are encoded on their own, and around each join a window of tokens is
encoded again, growing until its first and last token are the ones both sides
already had.  Every neighbouring pair of the result is then a pair some correct
encoding holds, which fixes the encoding uniquely.

Texts above ``SEGMENT_CHARS`` are cut into segments that separate tasks
encode; a second step joins the segments of a text in the same way.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gradeflow.llm.common import rows

LEAF = 96              # bytes merged in one go; longer pieces are concatenated
SEGMENT_CHARS = 1 << 20
CACHE_ENTRIES = 100_000
PIECE_ENTRIES = 300_000  # of a vocabulary, which stays with its worker
KEEP_CHARS = 64

#: The split pattern of byte-level vocabularies (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the split pattern sees it (the Unicode property), fixed value.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPLIT = regex.compile(SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]").replace(
    r"\s+(?!\S)|\s+", rf"[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"), regex.V0)
#: Marks that form one piece when they end a word.
_MARKS = ".,!?;:%&*#$"
_UNEVEN = regex.compile(rf" [{_SPACE}]|[{_SPACE}]\Z")


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character, the convention of byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out


class BoundedCache(dict):
    """Computes what it lacks.  When full, its entries become the old
    generation, from which those still in use come back: bounded memory, the
    same answers."""

    def __init__(self, make: Callable, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > KEEP_CHARS:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def unpack(data: bytes) -> list[int]:
    return memoryview(data).cast("I").tolist()


def pieces(text: str) -> list[str]:
    return _SPLIT.findall(text)


def spaced_words(text: str) -> list[str] | None:
    """``text.split(' ')`` where each word but the first starts a new piece
    with the blank before it; None when blanks meet other white space."""
    return None if _UNEVEN.search(text) else text.split(" ")


def letters_and_marks(word: str) -> tuple[str | None, str]:
    """A word of letters and then plain marks is two pieces; None for others,
    which need the pattern."""
    core = word.rstrip(_MARKS)
    return (core, word[len(core):]) if core.isalpha() else (None, "")


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.byte_ids = [vocab[alphabet[b]] for b in range(256)]
        # (left, right) -> rank and merged id packed in one integer: the
        # smallest value is the merge to do next
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        of_char = {c: b for b, c in alphabet.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes: dict[int, bytes] = {
            i: bytes(of_char[c] for c in t) for t, i in vocab.items() if t not in self.added}
        self.token_bytes |= {i: t.encode() for t, i in self.added.items()}
        self._added = regex.compile("|".join(
            regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.id_text = {i: str(i) for i in self.token_bytes}
        # caches of pieces hold ids as packed bytes: a few dozen bytes an entry
        self.words = BoundedCache(lambda p: pack(self.encode_piece(p.encode())), PIECE_ENTRIES)
        self.units = BoundedCache(self._unit, PIECE_ENTRIES)

    # -- merging ----------------------------------------------------------
    def merge(self, data: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in data]
        return self._merge_long(ids) if len(ids) > LEAF else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, none = self.merges.get, 1 << 62
        ks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ks:
            best = min(ks)
            if best == none:
                break
            i, new = ks.index(best), best & 0xFFFFF
            ids[i:i + 2] = [new]
            del ks[i]
            if i < len(ks):
                ks[i] = get(new << 20 | ids[i + 1], none)
            if i:
                ks[i - 1] = get(ids[i - 1] << 20 | new, none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, n = self.merges.get, len(ids)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or get(ids[i] << 20 | ids[j]) != m:
                continue
            ids[i], alive[j], k = m & 0xFFFFF, False, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if (x := get(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := get(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (x, h))
        return [t for t, a in zip(ids, alive) if a]

    # -- tree concatenation -----------------------------------------------
    def encode_piece(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merge(data)
        mid = len(data) // 2
        return self.join(self.encode_piece(data[:mid]), self.encode_piece(data[mid:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both sides' bytes from their encodings."""
        if not left or not right:
            return left + right
        i = j = 2
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(self.to_bytes(left[-i:] + right[:j]))
            left_agrees = i == len(left) or window[0] == left[-i]
            right_agrees = j == len(right) or window[-1] == right[j - 1]
            if left_agrees and right_agrees:
                return left[:-i] + window + right[j:]
            i, j = i if left_agrees else 2 * i, j if right_agrees else 2 * j

    def join_all(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k]
                     for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    # -- texts --------------------------------------------------------------
    def _unit(self, word: str) -> bytes:
        """Ids of a word with the blank before it."""
        core, tail = letters_and_marks(word)
        if core is None:
            return self._pieces(" " + word)
        return self.words[" " + core] + self.words[tail] if tail else self.words[" " + core]

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, pieces(text)))

    def split_added(self, text: str) -> Iterator[tuple[str, int | None]]:
        """(plain text, None) and (added token, id) in order."""
        at = 0
        for m in self._added.finditer(text) if self._added else ():
            if m.start() > at:
                yield text[at:m.start()], None
            yield m.group(), self.added[m.group()]
            at = m.end()
        if at < len(text):
            yield text[at:], None

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and the empty text have none."""
        out: list[bytes] = []
        for part, added in self.split_added(text or ""):
            if added is not None:
                out.append(pack([added]))
            elif (words := spaced_words(part)) is None:
                out.append(self._pieces(part))
            else:
                out.append(self._pieces(words[0]))
                out.append(b"".join(map(self.units.__getitem__, words[1:])))
        return unpack(b"".join(out))

    def to_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids (special tokens kept); bytes that are no UTF-8 become
        the replacement character, ids outside the vocabulary are left out."""
        known = self.token_bytes
        try:
            data = b"".join(map(known.__getitem__, ids))
        except KeyError:
            data = b"".join([known.get(i, b"") for i in ids])
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """One vocabulary per worker process."""
    return ByteBpe(path)


# -- frames -----------------------------------------------------------------
Emit = Callable[[ByteBpe, list[int]], dict]


def ids_and_text(bpe: ByteBpe, ids: list[int]) -> dict:
    return {"ids": ids, "decoded": bpe.decode(ids)}


def digests(bpe: ByteBpe, ids: list[int]) -> dict:
    return {"n_tokens": len(ids),
            "ids_sha256": hashlib.sha256(",".join(map(bpe.id_text.__getitem__, ids)).encode()).hexdigest(),
            "decoded_sha256": hashlib.sha256(bpe.decode(ids).encode()).hexdigest()}


def _segments(bpe: ByteBpe, text: str, size: int) -> Iterator[tuple[int, bytes, bool]]:
    """(piece number, bytes, is one added token) of a long text: a long piece
    gives several segments under one number, short pieces share a segment."""
    k, run, run_len = 0, [], 0
    for part, added in bpe.split_added(text):
        for p in [part] if added is not None else pieces(part):
            if run and (added is not None or run_len + len(p) > size):
                yield k, json.dumps(run).encode(), False
                k, run, run_len = k + 1, [], 0
            if added is not None:
                yield k, json.dumps([p]).encode(), True
                k += 1
            elif len(p) > size:
                data = p.encode()
                for at in range(0, len(data), size):
                    yield k, b"\0" + data[at:at + size], False
                k += 1
            else:
                run.append(p)
                run_len += len(p)
    if run:
        yield k, json.dumps(run).encode(), False


def encode_frame(df: DataFrame, path: str, emit: Emit, out_schema: str, key: str = "doc_id",
                 text: str = "text", segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row per input row: the key and what ``emit`` makes of the ids.

    Null and empty texts have no ids; rows that repeat give equal rows; keys
    may be null or repeat; other columns are ignored, whatever their names."""
    src = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key_type = src.schema["key"].dataType.simpleString()
    fields = [f.split()[0] for f in out_schema.split(",")]
    schema = f"key {key_type}, {out_schema}"

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def arrow(keys, outs) -> pa.RecordBatch:
        cols = {"key": keys} | {f: [o[f] for o in outs] for f in fields}
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in kinds], schema=kinds)

    def whole(batches):
        bpe = load(path)
        for b in batches:
            outs = [emit(bpe, bpe.encode(t)) for t in b.column("text").to_pylist()]
            yield arrow(b.column("key").to_pylist(), outs)

    def cut_up(batches):
        bpe = load(path)
        for keys, uids, texts in rows(batches, "key", "uid", "text"):
            for k, u, t in zip(keys, uids, texts):
                parts = [*_segments(bpe, t, max(1, segment_chars // 16))]
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array([k] * len(parts), kinds.field("key").type), "uid": [u] * len(parts),
                    "seq": pa.array(range(len(parts)), pa.int32()),
                    "piece": pa.array([p[0] for p in parts], pa.int32()), "data": [p[1] for p in parts],
                    "added": [p[2] for p in parts]})

    def encode_parts(batches):
        bpe = load(path)
        for b in batches:
            ids = []
            for data, added in zip(b.column("data").to_pylist(), b.column("added").to_pylist()):
                if data[:1] == b"\0":
                    got = bpe.encode_piece(data[1:])
                elif added:
                    got = [bpe.added[json.loads(data)[0]]]
                else:
                    got = unpack(b"".join(map(bpe.words.__getitem__, json.loads(data))))
                ids.append(pack(got))
            yield pa.RecordBatch.from_pydict({
                "key": b.column("key"), "uid": b.column("uid"), "seq": b.column("seq"),
                "piece": b.column("piece"), "ids": ids})

    def put_together(t: pa.Table) -> pa.Table:
        bpe = load(path)
        t = t.sort_by("seq")
        out, at = [], 0
        ids = [unpack(x) for x in t["ids"].to_pylist()]
        piece = t["piece"].to_pylist()
        while at < len(ids):
            end = at
            while end < len(ids) and piece[end] == piece[at]:
                end += 1
            out += bpe.join_all(ids[at:end])
            at = end
        return pa.Table.from_batches([arrow(t["key"].to_pylist()[:1], [emit(bpe, out)])])

    is_long = F.length("text") > segment_chars
    short = src.where(~is_long).mapInArrow(whole, schema)
    long = (src.where(is_long).withColumn("uid", F.monotonically_increasing_id())
            .mapInArrow(cut_up, f"key {key_type}, uid long, seq int, piece int, data binary, added boolean")
            .repartition("uid", "seq")
            .mapInArrow(encode_parts, f"key {key_type}, uid long, seq int, piece int, ids binary")
            .groupBy("uid").applyInArrow(put_together, schema))
    return short.unionByName(long).withColumnRenamed("key", key)


def encode_decode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                  segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """key, ids, decoded: the general form of the operator."""
    return encode_frame(df, path, ids_and_text, "ids array<int>, decoded string", key, text, segment_chars)


def encode_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                   segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256."""
    return encode_frame(df, path, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                        key, text, segment_chars)
