"""Byte-level BPE against the tiktoken library, chunk by chunk and through Spark."""

import base64
import hashlib
import random
import time

import numpy as np
import pytest

pt = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
from notewright.llm import byte_bpe as bb  # noqa: E402

PATH = pt.path("byte_bpe_multi_50k.tiktoken")
BITS = [" ", "  ", "\n", "\r\n", "\t", "\xa0", "a", "the", "ing", "é", "日本", "語", "1", "23", "٣", "'s", "'ll", "'", ".", "!!", "<|endoftext|>", "😀", "é", "\x00", " word", " Straße", "zzzz"]


def ranks():
    return bb.Ranks.of(PATH, pt.PATTERN)


def library():
    with open(PATH, "rb") as f:
        rows = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=rows, special_tokens={})


def texts(n, most, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, most))) for _ in range(n)] + ["", " ", "a ", "  \n "]


def test_ids_equal_the_library():
    lib, rng = library(), random.Random(4)
    t = texts(1500, 40) + ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(300)) for _ in range(30)] + ["x" * n for n in (63, 64, 65, 66, 500)]
    t += ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (60, 64, 65, 3000)]
    ids, at, _, _ = ranks().step(t)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [lib.encode_ordinary(x) for x in t]
    assert ranks().decoded(ids, at).to_pylist() == [x.encode() for x in t]


def test_both_ways_of_merging_agree():
    r, rng = ranks(), random.Random(8)
    for n in (2, 3, 9, 40):
        own = [bytes(rng.choice(b"etaoin shrdlu\xc3\xa9") for _ in range(n)) for _ in range(60)]
        found = r.merged(np.frombuffer(b"".join(own), np.uint8).reshape(-1, n))
        assert [[x for x in row if x >= 0] for row in found.tolist()] == [r.merged_long(o) for o in own]


def in_chunks(text, chunk, overlap):
    own = [text[s : s + chunk + overlap] for s in range(0, len(text), chunk)]
    out = []
    for k, t in enumerate(own):
        ids, _, chars, each = ranks().step([t])
        out.append(bb.Chunk(k, chars[0], each[0], ids, chunk))
    return bb.stitched(ranks(), out).tolist()


def test_stitched_chunks_equal_the_library():
    lib, rng = library(), random.Random(5)
    t = [x for x in texts(200, 120, 3) if x] + ["x" * 700, "ab " * 300, " " * 400, " " * 99 + "x", "\n \n" * 90, "日" * 300, "1" * 200 + "a" * 300 + " b" * 50 + "!" * 200]
    t += ["".join(rng.choice([" ", "w" * rng.randint(1, 90), "7" * rng.randint(1, 60), " " * rng.randint(1, 50)]) for _ in range(30)) for _ in range(60)]
    for x in t:
        for chunk, overlap in ((16, 4), (40, 13), (7, 1), (64, 64), (5, 12)):
            assert in_chunks(x, chunk, overlap) == lib.encode_ordinary(x), (x, chunk, overlap)


def test_an_unbroken_text_takes_linear_time():
    rng, took = random.Random(6), []
    for n in (200_000, 800_000):
        x = "".join(rng.choice("abcdefghij") for _ in range(n))
        began = time.time()
        got = in_chunks(x, bb.CHUNK, bb.OVERLAP)
        took.append(time.time() - began)
        assert ranks().decoded(np.array(got, np.uint32), np.array([0, len(got)]))[0].as_py() == x.encode()
    assert took[1] < 12 * took[0] + 2


def test_query(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, a chunk's border in every place."""
    lib, rng = library(), random.Random(7)
    long = ["".join(rng.choice(BITS + [" thing", ", and"] * 6) for _ in range(60_000)), "y" * 100_000, "a " * 40_000 + "x" * 90_000 + " b" * 30_000]
    rows = [(None, None), (1, ""), (2, "two  words"), (2, "two  words"), *((10 + i, t) for i, t in enumerate(long)), (10, long[0]), (None, long[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, bb.op13_byte_bpe(spark, str(tmp_path)).collect()), key=repr)
    ids = [lib.encode_ordinary(t or "") for _, t in rows]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == sorted(((d, len(i), sha(np.array(i, "<u4").tobytes()), sha((t or "").encode())) for (d, t), i in zip(rows, ids)), key=repr)


def test_columns_and_round_trip(spark):
    df = spark.createDataFrame([(1, "one two", 5, b"x", 3), (2, "o" * 90, 5, None, 3), (3, None, 5, None, 3)], "doc_id long, text string, _key int, decoded binary, number int")
    out = bb.decoded(bb.encoded(df, PATH, pt.PATTERN, chunk=20, overlap=4), PATH, pt.PATTERN)
    assert sorted((r.doc_id, r._key, r.number, bytes(r.decoded)) for r in out.collect()) == [(1, 5, 3, b"one two"), (2, 5, 3, b"o" * 90), (3, 5, 3, b"")]
    assert bb.encoded(df.limit(0), PATH, pt.PATTERN).count() == 0
