"""Token counts and SentencePiece ids against the libraries."""

import random
import time


import pyarrow as pa
import pytest

pt = pytest.importorskip("public_tokenizers")
from notewright.llm import sentencepiece_codec as sp  # noqa: E402
from notewright.llm import token_counts as tc  # noqa: E402

BITS = [" ", "  ", "\n", "\t", "　", "\x85", "\x1c", "\xa0", "​", "a", "the", "ing", "é", "日本", "1", "23", "'s", "'", ".", "!!", "<|endoftext|>", "<|endo", "😀", "\x0b", " ", "\r\n", "▁", "\x00"]


def texts(n, most, seed=1, bits=BITS):
    rng = random.Random(seed)
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, most))) for _ in range(n)] + ["", " ", "a ", None]


def test_counts_equal_the_library():
    tok = tc.BytePairs.of(pt.path("byte_bpe_50k.json"))
    t = texts(4000, 40)
    assert tc.counted(tok, pa.array(t)).tolist() == tok.sizes([x or "" for x in t])


def test_spliced_chunks_equal_the_library():
    tok = tc.BytePairs.of(pt.path("byte_bpe_50k.json"))
    t = texts(150, 900, 2, BITS + [" "] * 20 + ["word", "zzzzzzzzzzzzzz"] * 5)[:-1] + ["x" * 3000, "ab " * 2000, " " * 3000]
    assert [tc.spliced(tok, x, 64, 8) for x in t] == tok.sizes(t)


def test_texts_without_stable_blanks_take_linear_time():
    tok, rng, took = tc.BytePairs.of(pt.path("byte_bpe_50k.json")), random.Random(5), []
    for n in (100_000, 400_000, 1_600_000):
        x = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        began = time.time()
        got = tc.spliced(tok, x)
        took.append(time.time() - began)
        assert got == tok.sizes([x])[0]
    assert took[1] < 4 and took[2] < 8 * took[1] + 1
    for x in ("ab  " * 60_000, "\n" * 200_000, "a b " * 20_000 + "z" * 90_000 + " c d" * 20_000, "z" * 9_000 + " y" + "z" * 50_000 + " x."):
        assert tc.spliced(tok, x) == tok.sizes([x])[0]


def test_count_query_columns(spark):
    df = spark.createDataFrame([(None, None, 1), (2, "", 2), (2, "", 2), (3, "hi there", 3)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, tc.token_counts(df, pt.path("byte_bpe_50k.json"), limit=1).collect()), key=repr)
    assert got == sorted([(None, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (3, 8, 2, True)], key=repr)
    assert tc.token_counts(df.limit(0), pt.path("byte_bpe_50k.json")).count() == 0


def test_huge_texts_through_the_query(spark, tmp_path, monkeypatch):
    """Texts of over HUGE_CHARS are spliced, special strings and all, and count as the library counts them."""
    tok = tc.BytePairs.of(pt.path("byte_bpe_50k.json"))
    rng = random.Random(9)
    long = ["".join(rng.choice(BITS + [" ", " word", " thing", ", and"] * 8) for _ in range(40_000)), "a " * 40_000, "x" * 70_000, "é日 " * 30_000 + "<|endoftext|> end<|endoftext|>", ""]
    assert sum(len(t) > 65_536 for t in long) == 4
    spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tc.op6_token_counts(spark, str(tmp_path)).collect()}
    sizes = tok.sizes(long)
    assert got == {i: (len(t.encode()), n, n > 512) for i, (t, n) in enumerate(zip(long, sizes))}
    calls = []
    monkeypatch.setattr(tc, "spliced", lambda tok, text: calls.append(len(text)) or 0)
    tc.counted(tok, pa.array(long))
    assert len(calls) == 4


def test_other_files_are_not_cut():
    """A file of another kind of tokenizer: whole texts, as the library gives them."""
    tok = tc.BytePairs(pt.path("word_bpe_49k.json"))
    t = texts(300, 40)
    assert not tok.cuttable and tc.counted(tok, pa.array(t)).tolist() == tok.sizes([x or "" for x in t])


def models():
    from sentencepiece import sentencepiece_model_pb2 as pb

    raw = sp.model_bytes()
    proto = pb.ModelProto()
    proto.ParseFromString(raw)
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        if p.score < -1e8:
            p.score = -40000 - i
    return {"bpe": raw, "unigram": proto.SerializeToString()}


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_ids_equal_the_library(kind):
    import sentencepiece

    model = models()[kind]
    pieces, library = sp.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    t = texts(2500, 30) + ["xy" * 400, "Wh" * 90 + "日" * 200]
    ids, at = pieces.encoded(pa.array(t))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(x or "") for x in t]
    assert pieces.decoded(ids, at) == [(x or "").replace("▁", " ") for x in t]


def test_a_very_long_text_has_the_librarys_ids():
    import sentencepiece

    rng, model = random.Random(13), sp.model_bytes()
    text = " ".join("".join(rng.choice("abcdefghij\u00e9\u65e5") for _ in range(rng.randint(1, 14))) for _ in range(120_000)) + "\n" * 500 + "x" * 2000
    pieces = sp.Pieces(model)
    ids, at = pieces.encoded(pa.array([text, "", text[:50]]))
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(x) for x in (text, "", text[:50])]
    assert pieces.decoded(ids, at)[0] == text


def test_encoded_frame(spark):
    df = spark.createDataFrame([(None, None, [1]), (1, "two  words", [2]), (1, "two  words", [2])], "doc_id long, text string, ids array<int>")
    rows = sp.encoded(df, sp.model_bytes(), "back").collect()
    assert [r.back for r in rows] == ["", "two  words", "two  words"] and rows[0].ids == [] and rows[1].ids == rows[2].ids
    assert [r.decoded for r in sp.decoded(sp.encoded(df, sp.model_bytes()), sp.model_bytes()).collect()] == ["", "two  words", "two  words"]
    assert sp.encoded(df.limit(0), sp.model_bytes()).count() == 0


def test_unknown_normaliser_is_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(sp.model_bytes())
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        sp.Pieces(proto.SerializeToString())

