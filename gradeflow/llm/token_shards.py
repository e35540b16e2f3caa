"""Token-id shards with a keyed index (operator 2).

Layout below one folder::

    shard-00007.ids     raw little-endian ids (2 bytes each when the
                        vocabulary has at most 65,536 ids, else 4), documents
                        one after another in key order, end id after each
    index-00003.mph     minimal perfect hash of the keys of one hash bucket:
                        bit levels, ranks, and per slot a stored fingerprint,
                        the shard, the first id's offset and the id count

A key costs one index file, a handful of bit probes and one ranged read.
Files are written under a temporary name and renamed, and their content
depends on the rows alone, so a task that runs again replaces like by like.
"""

from __future__ import annotations

import io
import os
import uuid
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.llm.bpe import BoundedCache, byte_alphabet, letters_and_marks, pieces, spaced_words
from gradeflow.llm.common import mix64, open_fs, spread, write_scratch

END_ID = 0
KEYS_PER_INDEX = 50_000
PIECE_ENTRIES = 600_000
GAMMA = 2.0


class LibraryEncoder:
    """Ids from the tokenizers library: its model encodes each distinct piece,
    words are put together from cached pieces.  Texts that hold an added token
    go to the library whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.width = 2 if self.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.letters = {b: ord(c) for b, c in byte_alphabet().items()}
        self.blank = chr(self.letters[32])
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.tokenize = self.lib.model.tokenize
        self.words = BoundedCache(self._piece, PIECE_ENTRIES)
        self.units = BoundedCache(self._unit, PIECE_ENTRIES)

    def pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, p: str) -> bytes:
        if p.isascii() and p.isprintable():  # of these, only the blank is written otherwise
            shown = p.replace(" ", self.blank)
        else:
            shown = p.encode().decode("latin-1").translate(self.letters)
        return self.pack([t.id for t in self.tokenize(shown)])

    def _unit(self, word: str) -> bytes:
        core, tail = letters_and_marks(word)
        if core is None:
            return self._pieces(" " + word)
        return self.words[" " + core] + self.words[tail] if tail else self.words[" " + core]

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, pieces(text)))

    def encode(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self.pack(self.lib.encode(text, add_special_tokens=False).ids)
        words = spaced_words(text)
        if words is None:
            return self._pieces(text)
        return self._pieces(words[0]) + b"".join(map(self.units.__getitem__, words[1:]))


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


# -- minimal perfect hash ----------------------------------------------------
def _level_hash(h: np.ndarray, f: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(h + mix64(f + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)))


def _fingerprint(h: np.ndarray, f: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(f ^ (h * np.uint64(0xD6E8FEB86659FD93))) >> np.uint64(32)).astype(np.uint32)


@dataclass
class PerfectHash:
    """Levels of bits: a key's slot is the rank of the first level at which it
    was alone.  Slots are exactly 0 .. n-1."""

    sizes: np.ndarray
    bits: np.ndarray      # all levels, one bit each, packed in 64-bit words
    ranks: np.ndarray     # set bits before each word

    @classmethod
    def build(cls, h: np.ndarray, f: np.ndarray) -> PerfectHash:
        sizes, marks, level = [], [], 0
        while len(h):
            m = max(64, -(-int(GAMMA * len(h)) // 64) * 64)
            at = _level_hash(h, f, level) % np.uint64(m)
            alone = np.bincount(at.astype(np.int64), minlength=m) == 1
            sizes.append(m)
            marks.append(alone)
            left = ~alone[at.astype(np.int64)]
            h, f, level = h[left], f[left], level + 1
            if level > 200:
                raise ValueError("two keys share both hashes")
        flat = np.concatenate(marks) if marks else np.zeros(0, bool)
        words = np.packbits(flat, bitorder="little").view(np.uint64) if len(flat) else np.zeros(0, np.uint64)
        ones = np.bitwise_count(words).astype(np.int64)
        return cls(np.array(sizes, np.int64), words, np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int64)
                   if len(words) else np.zeros(0, np.int64))

    def slots(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level holds it."""
        out, todo, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, m in enumerate(self.sizes):
            at = (_level_hash(h[todo], f[todo], level) % np.uint64(m)).astype(np.int64) + base
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (self.ranks[at >> 6] + below)[hit]
            todo, base = todo[~hit], base + int(m)
            if not len(todo):
                break
        return out


def put_file(uri: str, data: bytes) -> None:
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as f:
        f.write(data)
    fs.move(tmp, path)


def get_file(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


# -- writing -----------------------------------------------------------------
def _key_columns(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Two independent 64-bit hashes of (key, ordinal) and the index bucket."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("\0null"))
    return df.withColumns({"h": F.xxhash64(k, F.col(ordinal)),
                           "f": F.xxhash64(F.col(ordinal), k, F.lit("fingerprint"))})


def write_shards(df: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text",
                 shards: int | None = None) -> DataFrame:
    """Encode, append the end id, write shard files in key order and the index.

    Returns the manifest (key, ordinal, shard, n_tokens, start, h, f, bucket).
    Null texts count as empty (one end id); null keys come first; rows of one
    key follow each other and are told apart by ``ordinal``.  An empty table
    writes no file."""
    spark = df.sparkSession
    n = shards or spread(df)
    src = (df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
           .withColumn("tie", F.xxhash64("text")))
    key_type = src.schema["key"].dataType.simpleString()

    def write(batches):
        enc, out, tmp, fs = encoder(path), None, None, None
        where = pos = row = 0
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                where = b.column("shard")[0].as_py()
                fs, name = open_fs(f"{folder}/shard-{where:05d}.ids")
                fs.create_dir(os.path.dirname(name), recursive=True)
                tmp = f"{name}.{uuid.uuid4().hex}.tmp"
                out = fs.open_output_stream(tmp)
            counts = []
            for text in b.column("text").to_pylist():
                data = enc.encode(text) + enc.pack([END_ID])
                out.write(data)
                counts.append(len(data) // enc.width)
            first = pos + np.cumsum([0, *counts[:-1]])
            pos += sum(counts)
            yield pa.RecordBatch.from_pydict({
                "key": b.column("key"), "shard": b.column("shard"), "row": pa.array(range(row, row + b.num_rows), pa.int64()),
                "first": pa.array(first, pa.int64()), "n_tokens": pa.array(counts, pa.int64()),
                "width": pa.array([enc.width] * b.num_rows, pa.int32())})
            row += b.num_rows
        if out is not None:
            out.close()
            fs.move(tmp, name)

    placed = (src.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie", "text")
              .withColumn("shard", F.spark_partition_id())
              .mapInArrow(write, f"key {key_type}, shard int, row long, first long, n_tokens long, width int"))
    placed = write_scratch(placed, "token-manifest")  # runs the writers once
    # a row per shard: its first row and first id in the whole output
    w = "OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    bases = placed.groupBy("shard").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).select(
        "shard", F.expr(f"coalesce(sum(n) {w}, 0)").alias("row0"), F.expr(f"coalesce(sum(t) {w}, 0)").alias("id0"))
    rec = placed.join(F.broadcast(bases), "shard").withColumns(
        {"rec": F.col("row0") + F.col("row"), "start": F.col("id0") + F.col("first")})
    least = rec.groupBy(F.col("key").alias("of")).agg(F.min("rec").alias("rec0"))
    rec = rec.join(least, F.col("key").eqNullSafe(F.col("of"))).select(
        "key", (F.col("rec") - F.col("rec0")).alias("ordinal"), "shard", "first", "n_tokens", "start", "width")
    buckets = max(1, -(-placed.count() // KEYS_PER_INDEX))
    out = _key_columns(rec, "key", "ordinal").withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))

    def index(t: pa.Table) -> pa.Table:
        h, f = (t[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h", "f"))
        mph = PerfectHash.build(h, f)
        slot = mph.slots(h, f)
        cols = {"fp": _fingerprint(h, f), "shard": t["shard"].to_numpy().astype(np.int32),
                "first": t["first"].to_numpy(), "n": t["n_tokens"].to_numpy()}
        placed_cols = {}
        for c, v in cols.items():
            placed_cols[c] = np.empty_like(v)
            placed_cols[c][slot] = v
        buf = io.BytesIO()
        np.savez(buf, sizes=mph.sizes, bits=mph.bits, ranks=mph.ranks, width=t["width"].to_numpy()[:1], **placed_cols)
        bucket = t["bucket"][0].as_py()
        put_file(f"{folder}/index-{bucket:05d}.mph", buf.getvalue())
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "keys": pa.array([len(h)], pa.int64())})

    out = write_scratch(out.withColumnRenamed("key", key), "token-keys")
    out.groupBy("bucket").applyInArrow(index, "bucket int, keys long").agg(F.sum("keys")).collect()
    return out


# -- reading -----------------------------------------------------------------
def read_tokens(keys: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """Look up rows of (key columns, h, f, bucket) in the index and read their
    ids: adds ``shard``, ``first``, ``n_tokens``, ``ids_crc32`` (of the ids as
    4-byte little-endian) and, on request, ``ids``.  A key that the index does
    not hold gets nulls: its fingerprint or its bits disagree."""
    names = [c for c in keys.columns if c not in ("h", "f", "bucket")]
    fields = [keys.schema[c] for c in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += ", shard int, first long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def look_up(t: pa.Table) -> pa.Table:
        z = np.load(io.BytesIO(get_file(f"{folder}/index-{t['bucket'][0].as_py():05d}.mph")))
        h, f = (t[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h", "f"))
        slot = PerfectHash(z["sizes"], z["bits"], z["ranks"]).slots(h, f)
        known = slot >= 0
        known[known] = z["fp"][slot[known]] == _fingerprint(h[known], f[known])
        width = int(z["width"][0])
        shard, first, n = (z[c][np.where(known, slot, 0)] for c in ("shard", "first", "n"))
        crc: list = [None] * len(h)
        ids: list = [None] * len(h)
        open_shard, src = -1, None
        for k in np.lexsort((first, shard)):
            if not known[k]:
                continue
            if shard[k] != open_shard:
                if src is not None:
                    src.close()
                fs, name = open_fs(f"{folder}/shard-{shard[k]:05d}.ids")
                src, open_shard = fs.open_input_file(name), shard[k]
            raw = np.frombuffer(src.read_at(int(n[k]) * width, int(first[k]) * width), f"<u{width}")
            crc[k] = zlib.crc32(raw.astype("<u4").tobytes())
            if with_ids:
                ids[k] = raw.astype(np.int64)
        if src is not None:
            src.close()
        cols = {c: t[c] for c in names} | {
            "shard": pa.array(shard, pa.int32(), mask=~known), "first": pa.array(first, pa.int64(), mask=~known),
            "n_tokens": pa.array(n, pa.int64(), mask=~known), "ids_crc32": pa.array(crc, pa.int64())}
        return pa.table(cols | ({"ids": pa.array(ids, pa.list_(pa.int64()))} if with_ids else {}))

    return keys.groupBy("bucket").applyInArrow(look_up, schema)


def keys_for(df: DataFrame, buckets: int, key: str = "doc_id") -> DataFrame:
    """Index keys of the first row of each given key value."""
    return _key_columns(df.select(key).withColumn("ordinal", F.lit(0).cast("long")), key, "ordinal").withColumn(
        "bucket", F.pmod("h", F.lit(buckets)).cast("int"))


def write_and_read(df: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, n_tokens, ids_crc32, read back from the written files."""
    manifest = write_shards(df, path, folder, key, text)
    return read_tokens(manifest.select(key, "start", "h", "f", "bucket"), folder, with_ids=False).select(
        key, "start", "n_tokens", "ids_crc32")
