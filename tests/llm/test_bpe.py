import hashlib
import random

import public_tokenizers
import pytest
from helpers import docs, small
from tokenizers import Tokenizer

from gradeflow.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.load(PATH)


def texts():
    rnd = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "the", "<|endoftext|>", "é", "1", "!!", "\x1c", "\xa0", "'s", "日本",
             "aaaaaaaa", " ", "İ", "ſ", "é", "​", "😀", "�", "\0"]
    out = ["".join(rnd.choices(parts, k=rnd.randint(0, 60))) for _ in range(400)]
    for k in range(60):  # long pieces without a split
        n = rnd.randint(90, 4000)
        out.append("".join(rnd.choices("abtheionsé", k=n)) if k % 2 else rnd.choice(["a", "ab", "=", "-_", "é"]) * n)
    return out + ["", " ", "   ", "a  ", " a", "a b  c"] + [r["text"] for r in small("documents")]


def test_ids_and_text_are_the_librarys(lib, own):
    for t in texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_every_character_is_split_alike(lib, own):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    probe = [f"a{c}{c}1 {c} {c}b" for c in chars]
    for at in range(0, len(probe), 100_000):
        got = lib.encode_batch_fast(probe[at:at + 100_000], add_special_tokens=False)
        assert [e.ids for e in got] == [own.encode(p) for p in probe[at:at + 100_000]]


def test_broken_utf8_and_unknown_ids(lib, own):
    rnd = random.Random(1)
    for _ in range(200):
        ids = rnd.choices(range(50_257), k=rnd.randint(0, 20))
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert own.decode([10 ** 6, own.encode("a")[0]]) == "a"


def test_join_agrees_with_one_pass(own):
    rnd = random.Random(2)
    for _ in range(150):
        data = "".join(rnd.choices(rnd.choice(["ab", "theions", "=-_", "aé"]), k=rnd.randint(2, 300))).encode()
        cut = rnd.randrange(1, len(data))
        assert own.join(own.merge(data[:cut]), own.merge(data[cut:])) == own._merge_long([own.byte_ids[b] for b in data])


def test_frame_with_segments(spark, lib):
    ts = [t for t in texts()[:80]] + ["x" * 5000 + " y " + "ab" * 900 + "<|endoftext|>" + "the end " * 300, None, ""]
    ts += ["same " * 200] * 2
    ids = [None if k % 17 == 0 else k for k in range(len(ts))]
    df = docs(spark, ts, ids, "n_tokens")
    want = sorted(((i, lib.encode(t or "", add_special_tokens=False).ids) for i, t in zip(ids, ts)), key=repr)
    for size in (1 << 20, 64):
        got = sorted(((r["doc_id"], r["ids"]) for r in bpe.encode_decode(df, PATH, segment_chars=size).collect()), key=repr)
        assert got == want
    d = {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in bpe.encode_digests(df, PATH).collect()}
    assert d == {(i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in want}


def test_empty_table(spark):
    assert bpe.encode_digests(docs(spark, []).limit(0), PATH).collect() == []
