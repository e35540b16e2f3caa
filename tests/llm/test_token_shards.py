import zlib

import numpy as np
import public_tokenizers
from helpers import docs, small
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradeflow.llm import token_shards as ts
from gradeflow.llm.common import open_fs, shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    lib, start, out = Tokenizer.from_file(PATH), 0, []
    for k, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_small_table_round_trip(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in small("documents"))
    df = docs(spark, [r[1] for r in rows], [r[0] for r in rows], "start").orderBy(F.rand(3))
    folder = shared_folder(spark, "t")
    got = ts.write_and_read(df, PATH, folder)
    assert sorted(map(tuple, got.collect())) == expected(rows)
    fs, path = open_fs(folder)
    from pyarrow.fs import FileSelector
    names = [f.base_name for f in fs.get_file_info(FileSelector(path))]
    assert not [n for n in names if n.endswith(".tmp")]
    raw = b"".join(open(f"{path}/{n}", "rb").read() for n in sorted(names) if n.startswith("shard"))
    assert len(raw) == 2 * sum(r[2] for r in expected(rows))


def test_null_and_shared_keys_and_odd_texts(spark):
    rows = [(None, "b"), (None, "a"), (1, None), (1, ""), (1, "x <|endoftext|> y"), (7, "z  z\n\n z"), (7, "z  z\n\n z"),
            (3, "w" * 3000)]
    df = docs(spark, [r[1] for r in rows], [r[0] for r in rows])
    got = [tuple(r) for r in ts.write_and_read(df, PATH, shared_folder(spark, "t")).collect()]
    assert sorted((k is not None, k or 0, n) for k, _, n, _ in got) == sorted(
        (k is not None, k or 0, n) for k, _, n, _ in expected(rows))
    spans = sorted((s, s + n) for _, s, n, _ in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert {(k, c) for k, _, _, c in got} == {(k, c) for k, _, _, c in expected(rows)}


def test_keyed_access_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(ts, "KEYS_PER_INDEX", 20)
    df = docs(spark, [f"text {k}" for k in range(100)], [3 * k for k in range(100)])
    folder = shared_folder(spark, "t")
    manifest = ts.write_shards(df, PATH, folder)
    n = manifest.agg(F.max("bucket")).first()[0] + 1
    assert n == 5
    asked = spark.createDataFrame([(k,) for k in range(0, 60)], "doc_id long")
    got = {r["doc_id"]: r["ids"] for r in ts.read_tokens(ts.keys_for(asked, n), folder).collect()}
    lib = Tokenizer.from_file(PATH)
    for k in range(60):
        want = [*lib.encode(f"text {k // 3}").ids, 0] if k % 3 == 0 else None
        assert got[k] == want


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000, 30_000):
        h, f = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        mph = ts.PerfectHash.build(h, f)
        assert sorted(mph.slots(h, f).tolist()) == list(range(n))
        print(n, len(mph.bits) * 64 / max(n, 1))


def test_empty_table(spark):
    assert ts.write_and_read(docs(spark, []).limit(0), PATH, shared_folder(spark, "t")).collect() == []
