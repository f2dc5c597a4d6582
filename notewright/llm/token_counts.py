"""Token counts of whole texts, exactly as a byte-level BPE tokenizer of the `tokenizers` library gives them.

A *stable* cut is a place at which byte-level pre-tokenizing starts a new piece whatever stands further away: before a
blank between two characters that are not white space, on both sides of such a line feed, and between an ASCII letter
and ASCII punctuation other than an apostrophe. Merges never cross pieces, so the encodings of both sides of a cut, put
together, are the encoding of the whole. That is proven for one kind of file only: BPE without dropout, byte-level
pre-tokenizing with its usual pattern and no prefix blank, no normaliser. With any other, whole texts are encoded.

Huge texts (over HUGE_CHARS) go in overlapping chunks encoded with offsets: two neighbours are spliced at the last blank
inside their overlap that is a stable cut and at which both have a token border; where the overlap has none, it is doubled and
encoded again; where the whole left chunk has none, that one is doubled, so the work stays linear in the text (at last it is one chunk). Strings of special tokens hold no white space, so none lies across such a blank.
Other texts are cut at every stable place and each distinct piece is encoded once per step, but for those with a special
token's string or Unicode white space, which are encoded whole.

Null and empty texts have no tokens. Repeated rows are counted each. The state is one step's distinct pieces and a
cache of at most CACHE pieces, whatever the input's size.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import lean, read, steps

HUGE_CHARS, CHUNK_CHARS, OVERLAP_CHARS = 16_384, 8_192, 256
CACHE, CACHED_CHARS, JOINED = 1_000_000, 24, 512
_STABLE = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict[str, BytePairs] = {}


class BytePairs:
    """A tokenizer file, loaded once in each worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder().values()
        self.specials = [t.content for t in added]
        spec = json.loads(self.library.to_str())
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        plain = not any(re.search(r"\s", t.content) or t.lstrip or t.rstrip or t.single_word for t in added)
        self.cuttable = usual and plain and spec["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout")
        self.cache: dict[str, int] = {}

    @staticmethod
    def of(path: str) -> BytePairs:
        if path not in _LOADED:
            _LOADED[path] = BytePairs(path)
        return _LOADED[path]

    def sizes(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def borders(self, text: str) -> np.ndarray:
        """Start of each token, in characters."""
        found = self.library.encode(text, add_special_tokens=False).offsets
        return np.fromiter((a for a, _ in found), np.int64, len(found))

    def pieces(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each distinct piece. Those that begin with a blank are encoded many as one text and told apart by offsets."""
        out = np.zeros(len(pieces), np.int64)
        new = []
        for i, p in enumerate(pieces):
            n = self.cache.get(p)
            if n is None:
                new.append(i)
            else:
                out[i] = n
        after_blank = [i for i in new if pieces[i][0] == " " and len(pieces[i]) > 1]
        alone = [i for i in new if pieces[i][0] != " " or len(pieces[i]) == 1]
        out[alone] = self.sizes([pieces[i] for i in alone])
        for k in range(0, len(after_blank), JOINED):
            part = [pieces[i] for i in after_blank[k : k + JOINED]]
            ends = np.cumsum([len(p) for p in part])
            out[after_blank[k : k + JOINED]] = np.bincount(np.searchsorted(ends, self.borders("".join(part)), side="right"), minlength=len(part))
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
        self.cache.update((pieces[i], int(out[i])) for i in new if len(pieces[i]) <= CACHED_CHARS)
        return out


#: Classes of bytes: 1 ASCII letter, 2 ASCII punctuation but the apostrophe, 3 white space, 0 any other.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_CLASS[[*range(9, 14), *range(28, 33)]] = 3


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces between stable cuts, and where those of each text begin."""
    texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _CLASS[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[1:-1] = (kind[:-1] + kind[1:] == 3) & (kind[:-1] != 3) & (kind[1:] != 3)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    inner = kind != 3
    lone = np.zeros(len(raw), bool)
    lone[1:-1] = ~inner[1:-1] & inner[:-2] & inner[2:] & ~edge[1:-2] & ~edge[2:-1]
    border[:-1] |= lone & ((raw == 32) | (raw == 10))
    border[1:] |= lone & (raw == 10)
    border |= edge
    at = np.flatnonzero(border)
    pieces = pa.LargeStringArray.from_buffers(max(len(at) - 1, 0), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
    return pieces, np.searchsorted(at, offsets)


def spliced(tok: BytePairs, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a huge text from overlapping chunks."""
    total, start, begin, stop, wide = 0, 0, 0, min(chunk, len(text)), overlap
    left = tok.borders(text[:stop])
    while stop < len(text):
        least = max(begin + 1, start)
        low = max(begin + 1, stop - wide) if _STABLE.search(text, least, stop) else least
        end = min(len(text), stop + chunk)
        joint = np.array([m.start() for m in _STABLE.finditer(text, low, stop)], np.int64)
        if len(joint):
            right = tok.borders(text[low:end]) + low
            joint = np.intersect1d(np.intersect1d(left, right), joint)
            joint = joint[(joint > low) & (joint >= start)]
        if len(joint):
            at = int(joint[-1])
            total += int(np.count_nonzero((left >= start) & (left < at)))
            start, begin, stop, left, wide = at, low, end, right, overlap
        elif low > least:
            wide *= 2
        else:  # nothing to hold on to up to here: the left chunk becomes twice as long, so that all growing together costs its end length twice
            stop = min(len(text), begin + 2 * (stop - begin))
            left, wide = tok.borders(text[begin:stop]) + begin, overlap
    return total + int(np.count_nonzero(left >= start))


def counted(tok: BytePairs, texts: pa.Array) -> np.ndarray:
    """Tokens of each text of a step."""
    out = np.zeros(len(texts), np.int64)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    if not tok.cuttable:
        return np.array(tok.sizes(texts.to_pylist()), np.int64)
    usual = chars <= HUGE_CHARS
    for i in np.flatnonzero(~usual):
        out[i] = spliced(tok, texts[int(i)].as_py())
    odd = pc.match_substring_regex(texts, r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]").to_numpy(zero_copy_only=False)
    for special in tok.specials:
        odd |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
    odd &= usual
    out[odd] = tok.sizes(texts.filter(pa.array(odd)).to_pylist())
    even = usual & ~odd
    pieces, first = cut(texts.filter(pa.array(even)))
    coded = pieces.dictionary_encode()
    sums = np.concatenate([[0], np.cumsum(tok.pieces(coded.dictionary.to_pylist())[coded.indices.to_numpy()])])
    out[even] = np.diff(sums[first])
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text); path: the tokenizer's file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        tok = BytePairs.of(path)
        for batch in steps(batches):
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            found = counted(tok, texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(found), pa.array(found > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
