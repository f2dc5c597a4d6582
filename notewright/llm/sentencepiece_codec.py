"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

A text is cut wherever no piece holds the two neighbouring characters (so before each word mark, around line feeds and at
most punctuation); no piece reaches across. Distinct words between cuts are encoded once per step, and words of equal length
advance together: hashes of all their substrings probe the sorted hashes of the pieces (the code points of a hit are
compared), and at each place the best candidate piece that ends there is kept as a backpointer by a vectorised maximum.

What is maximised depends on the model file. A unigram model: the sum of piece scores. A BPE model: the encoding of a
prefix ends in exactly one piece such that it and the piece before it, merged anew from single characters, stay these two; so
candidates are scored 1 if that holds and the part before has an encoding, else minus infinity. Both give the library's ids.
Characters without a piece become their UTF-8 bytes' pieces, or the unknown piece.

Null and empty texts have no ids. Decoding gives the normalised text back. Repeated rows are encoded each, with equal ids. A
tie of two candidates goes to the longer piece. A very long text is a step of its own. Only models with the identity
normaliser are taken; others raise ValueError. State: one step of text, and at most PAIRS pairs of pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, mixed, read, steps

MARK = "▁"
CELLS, LONG_WORD, STEP, TABLE_BITS, PAIR_BITS, PAIRS = 1 << 18, 128, 2 << 20, 24, 20, 200_000
_LOADED: dict[str, Pieces] = {}


class Pieces:
    """The pieces of a model file, loaded once in each worker."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or spec.treat_whitespace_as_suffix or spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models with the identity normaliser")
        self.bpe, self.prefix = spec.model_type == 2, norm.add_dummy_prefix
        self.text = [p.piece for p in proto.pieces]
        self.kind = np.array([p.type for p in proto.pieces])
        self.unknown = int(np.flatnonzero(self.kind == 2)[0])
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.text) if self.kind[i] == 6}
        usual = np.flatnonzero((self.kind == 1) | (self.kind == 4))
        if (self.kind == 4).any():
            raise ValueError("models with user-defined pieces are not taken")
        score = {int(i): float(proto.pieces[int(i)].score) for i in usual}
        self.score = np.array([score.get(i, 0.0) for i in range(len(self.text))])
        self.lost = min(score.values(), default=0.0) - 10.0  # the library's penalty for an unknown character
        self.ids = {self.text[i]: int(i) for i in usual}
        self.longest = max((len(t) for t in self.ids), default=1)
        units = np.zeros((len(usual), self.longest), np.uint32)
        for row, i in enumerate(usual):
            units[row, : len(self.text[i])] = np.fromiter(map(ord, self.text[i]), np.uint32)
        sizes = np.array([len(self.text[i]) for i in usual])
        hashes = np.zeros(len(usual), np.uint64)
        for n in np.unique(sizes):
            hashes[sizes == n] = _span_hash(units[sizes == n, :n])
        order = np.argsort(hashes)
        self.hashes, self.units, self.sizes, self.at = hashes[order], units[order], sizes[order], usual[order]
        if (np.diff(self.hashes) == 0).any():
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << 22, bool)  # most substrings that are no piece go no further than this
        self.maybe[self.hashes >> np.uint64(42)] = True
        self.inner = np.zeros(1 << TABLE_BITS, bool)  # hashed pairs of neighbours inside pieces
        for n in range(1, self.longest):
            long = units[sizes > n]
            self.inner[_pair_slot(long[:, n - 1], long[:, n])] = True
        self.alone = np.fromiter((self.bpe and t in self.ids and self.merged(t) == [t] for t in self.text), bool, len(self.text))
        # Pairs already judged: a table with one place a hash, and all of them behind it.
        self.pair_keys, self.pair_good = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.judged: dict[int, bool] = {}

    @staticmethod
    def of(name: str, model: bytes) -> Pieces:
        if name not in _LOADED:
            _LOADED[name] = Pieces(model)
        return _LOADED[name]

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging by its definition: the best pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def pairs_hold(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging gives back the two pieces; a character without a piece (-1) never merges."""
        out = (left < 0) | (right < 0)
        keys = (left * len(self.text) + right)[~out]
        if not len(keys):
            return out
        slot = (mixed(keys.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        hold = self.pair_good[slot]
        missing = np.flatnonzero(self.pair_keys[slot] != keys)
        if len(missing):
            if len(self.judged) > PAIRS:
                self.judged.clear()
            new, place = np.unique(keys[missing], return_inverse=True)
            good = np.empty(len(new), bool)
            for i, k in enumerate(new.tolist()):
                known = self.judged.get(k)
                if known is None:
                    known = self.judged[k] = self.pair_holds(*divmod(k, len(self.text)))
                good[i] = known
            hold[missing] = good[place]
            self.pair_keys[slot[missing]], self.pair_good[slot[missing]] = keys[missing], good[place]
        out[~out] = hold
        return out

    def pair_holds(self, left: int, right: int) -> bool:
        return self.merged(self.text[left] + self.text[right]) == [self.text[left], self.text[right]]

    def long_word(self, word: str) -> list[int]:
        """The same search place by place, for a word that has no others of its length to go with."""
        best, back, last = [0.0], [0], [-1]
        for end in range(1, len(word) + 1):
            top = (-np.inf, 1, -1)
            for k in range(min(self.longest, end), 0, -1):
                piece = self.ids.get(word[end - k : end], -1)
                if (piece < 0 and k > 1) or best[end - k] == -np.inf:
                    continue
                if not self.bpe:
                    value = best[end - k] + (self.score[piece] if piece >= 0 else self.lost)
                elif end == k:
                    value = 1.0 if piece < 0 or self.alone[piece] else -np.inf
                else:
                    value = 1.0 if self.pairs_hold(np.array([last[end - k]]), np.array([piece]))[0] else -np.inf
                if value > top[0]:
                    top = (value, k, piece)
            best.append(top[0])
            back.append(top[1])
            last.append(top[2])
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= back[at]
        return out[::-1]

    def viterbi(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, end to end, and how many each word has; units[word, place] are code points."""
        n, size = units.shape
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), np.int64)  # length of the last piece
        last = np.full((n, size + 1), -1, np.int64)  # its id, -1: a character without a piece
        hashes = np.zeros((n, 0), np.uint64)
        rows = np.arange(n)
        for end in range(1, size + 1):
            # hashes[:, k]: of the substring of length k + 1 that ends here
            hashes = _extended(hashes[:, : self.longest - 1], units[:, end - 1].astype(np.uint64))
            probe = mixed(hashes)
            w, k = np.nonzero(self.maybe[probe >> np.uint64(42)])
            probe = probe[w, k]
            at = np.minimum(np.searchsorted(self.hashes, probe), len(self.hashes) - 1)
            same = (self.hashes[at] == probe) & (self.sizes[at] == k + 1)
            w, k, at = w[same], k[same], at[same]
            same = np.ones(len(w), bool)
            for off in range(hashes.shape[1]):
                inside = np.flatnonzero(k >= off)
                if not len(inside):
                    break
                same[inside] &= self.units[at[inside], k[inside] - off] == units[w[inside], end - 1 - off]
            w, k, piece = w[same], k[same], self.at[at[same]]
            single = np.zeros(n, bool)
            single[w[k == 0]] = True
            lost = rows[~single]  # characters without a piece of their own
            w, k, piece = np.concatenate([w, lost]), np.concatenate([k, np.zeros(len(lost), np.int64)]), np.concatenate([piece, np.full(len(lost), -1)])
            begin = end - 1 - k
            reach = best[w, begin]
            if self.bpe:
                good = np.isfinite(reach)
                first = begin == 0
                good[first] &= (piece[first] < 0) | self.alone[piece[first]]
                check = np.flatnonzero(good & ~first)
                good[check] = self.pairs_hold(last[w[check], begin[check]], piece[check])
                value = np.where(good, 1.0, -np.inf)
            else:
                value = reach + np.where(piece < 0, self.lost, self.score[np.maximum(piece, 0)])
            width = hashes.shape[1]
            table = np.full((n, width), -np.inf)
            table[w, width - 1 - k] = value  # the longest piece first: it wins a tie
            found = np.full((n, width), -1, np.int64)
            found[w, width - 1 - k] = piece
            pick = np.argmax(table, axis=1)
            best[:, end], back[:, end], last[:, end] = table[rows, pick], width - pick, found[rows, pick]
        ids, used = np.zeros((n, size), np.int64), np.zeros((n, size), bool)
        at, place = np.full(n, size), size - 1
        while (at > 0).any():
            go = at > 0
            ids[go, place], used[go, place] = last[rows[go], at[go]], True
            missing = go & (ids[:, place] < 0)
            ids[missing, place] = -1 - units[missing, at[missing] - 1].astype(np.int64)  # tells the character
            at = at - np.where(go, back[rows, at], 0)
            place -= 1
        return ids[used], used.sum(axis=1)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words (UTF-32), end to end in any order, and for each word where its ids begin and end."""
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(words) + 1] // 4
        units = np.frombuffer(data, np.uint32)[: offsets[-1]] if data is not None else np.zeros(0, np.uint32)
        sizes, bounds, parts, done = np.diff(offsets), np.zeros((len(words), 2), np.int64), [], 0
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            block = max(1, CELLS // int(size * self.longest))
            for k in range(0, len(own), block):
                part = own[k : k + block]
                here = units[offsets[part][:, None] + np.arange(size)]
                if size > LONG_WORD:
                    each = [np.array([i if i >= 0 else -1 - u for i, u in self._placed(row)], np.int64) for row in here]
                    ids, counts = np.concatenate(each), np.array([len(x) for x in each])
                else:
                    ids, counts = self.viterbi(here)
                ends = done + np.cumsum(counts)
                bounds[part] = np.stack([ends - counts, ends], axis=1)
                parts.append(ids)
                done = int(ends[-1])
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), bounds

    def _placed(self, row: np.ndarray) -> list[tuple[int, int]]:
        """Ids of a long word, each with the character that it stands for if it has no piece."""
        out, at = [], 0
        for i in self.long_word(row.tobytes().decode("utf-32-le", "surrogatepass")):
            out.append((i, int(row[at])))
            at += len(self.text[i]) if i >= 0 else 1
        return out

    def _spelt(self, unit: int) -> list[int]:
        return [self.byte[b] for b in chr(unit).encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a step, and where each text's begin."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.prefix:
            marked = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), texts, pa.scalar("", pa.large_string()))
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, marked)
        chars = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
        units = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        units[units == 32] = ord(MARK)
        border = np.ones(len(units) + 1, bool)
        border[1:-1] = ~self.inner[_pair_slot(units[:-1], units[1:])]
        border[chars] = True
        at = np.flatnonzero(border) if len(units) else np.zeros(1, np.int64)
        split = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64) * 4), pa.py_buffer(units)])
        coded = split.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        ids, bounds = self.words(pa.concat_arrays([coded.dictionary]))
        begin, each = bounds[codes, 0], bounds[codes, 1] - bounds[codes, 0]
        total = np.concatenate([[0], np.cumsum(each)])
        out = ids[np.repeat(begin - total[:-1], each) + np.arange(total[-1])]
        starts = total[np.searchsorted(at, chars)]
        lost = np.flatnonzero(out < 0)
        if len(lost):  # characters without a piece, spelt in bytes
            kinds, which = np.unique(out[lost], return_inverse=True)
            spelt = [self._spelt(int(-1 - k)) for k in kinds]
            more = np.array([len(x) for x in spelt])[which]
            size = np.ones(len(out), np.int64)
            size[lost] = more
            place = np.concatenate([[0], np.cumsum(size)])
            wide = np.repeat(out, size)
            wide[np.repeat(place[lost], more) + np.concatenate([np.arange(m) for m in more.tolist()])] = np.concatenate([spelt[x] for x in which.tolist()])
            out, starts = wide, place[starts]
        return out.astype(np.int32), starts

    def spelling(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that each id stands for, end to end, and where they begin."""
        if not hasattr(self, "_spelling"):
            own = {1: lambda t: t.replace(MARK, " ").encode("utf-8", "surrogatepass"), 6: lambda t: bytes([int(t[3:5], 16)]), 2: lambda t: " \u2047 ".encode(), 5: lambda t: b""}
            each = [own.get(k, lambda t: b"")(t) for t, k in zip(self.text, self.kind.tolist(), strict=True)]
            self._spelling = np.frombuffer(b"".join(each), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return self._spelling

    def decoded(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The text of each list of ids: ids[starts[i]:starts[i + 1]]."""
        raw, at = self.spelling()
        size = np.diff(at)[ids]
        place = np.concatenate([[0], np.cumsum(size)])
        data = raw[np.repeat(at[:-1][ids] - place[:-1], size) + np.arange(place[-1])].tobytes()
        bounds = place[starts].tolist()
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            text = data[a:b].decode("utf-8", "replace")
            out.append(text[1:] if self.prefix and text.startswith(" ") else text)
        return out


def _pair_slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))) >> np.uint32(32 - TABLE_BITS)


def _extended(hashes: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Hashes of the substrings that end at this character, from those that ended one before: shortest first."""
    with np.errstate(over="ignore"):
        first = (unit + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        longer = hashes * np.uint64(0x100000001B3) + first[:, None]
        return np.concatenate([first[:, None], longer], axis=1)


def _span_hash(units: np.ndarray) -> np.ndarray:
    out = np.zeros(len(units), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(units.shape[1]):
            out = out * np.uint64(0x100000001B3) + (units[:, k].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(out)


def encoded(docs: DataFrame, model: bytes, decode: str | None = None) -> DataFrame:
    """docs with ids (array of int) of the text and, in the column that decode names, the text decoded from them.

    All other columns stay; those two are replaced if there.
    """
    name, docs = hashlib.sha256(model).hexdigest(), docs.drop("ids", *([decode] if decode else []))
    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField(decode, T.StringType())] if decode else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        pieces = Pieces.of(name, model)
        for batch in steps(batches, limit=STEP):
            ids, starts = pieces.encoded(batch.column("text"))
            new = [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))]
            if decode:
                new.append(pa.array(pieces.decoded(ids, starts), pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f.name for f in more)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def decoded(rows: DataFrame, model: bytes, column: str = "decoded") -> DataFrame:
    """rows with the text that their ids stand for, in column (replaced if there); null ids give an empty text."""
    name, rows = hashlib.sha256(model).hexdigest(), rows.drop(column)
    schema = T.StructType([*rows.schema.fields, T.StructField(column, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        pieces = Pieces.of(name, model)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                lists = pc.fill_null(batch.column("ids"), [])
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces.decoded(ids, starts), pa.string())], names=[*batch.schema.names, column])

    return rows.mapInArrow(run, schema)


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read on the driver; by default the public 32,000-piece model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_ids, ids, round_trip (whether decoding gives the text back, bare word marks read as blanks)."""
    rows = encoded(read(spark, sf_dir, "documents").select("doc_id", "text"), model_bytes(), "decoded")
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_ids"), "ids", (F.col("decoded") == F.replace(text, F.lit(MARK), F.lit(" "))).alias("round_trip"))
