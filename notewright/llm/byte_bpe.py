"""Byte-level BPE encoding and decoding by a rank file, with overlapping chunks.

Texts are cut into chunks of CHUNK characters, each with OVERLAP characters of the next one. A chunk is pre-tokenised from its own start,
wherever that falls, and its pieces are encoded. The pattern looks at nothing before a match, so from a place where a text's true
pieces and those of a chunk both have a border, the chunk's are the true ones; and a match that ends LOOK characters before its chunk's
end is what it would be in the whole text. Neighbours are stitched at the first border that both have inside their overlap. Where there is none (a piece
longer than the overlap), the text is put together again from the decoded bytes of the chunks and pre-tokenised from the last true
border on, over more and more chunks, doubling, until a border is one of a chunk's again; so the work stays linear in the text.

A text of one chunk is encoded where it is read. The chunks of longer ones are dealt out by (digest of the text, number), equal ones once,
so a huge text is pre-tokenised by many tasks; then what is left of each chunk (ids and sizes of its pieces) meets at its text's digest, where it
is stitched, and the result is joined to the rows that hold the text. The pieces of a step are encoded by length, all of one length together:
each round merges the leftmost pair of least rank of every piece. Pieces over LONG bytes keep their pairs in a heap instead, by the
same rule. Decoding concatenates the bytes of the ids, many texts in one copy.

Null and empty texts have no ids. Any text can be encoded, as the file has all 256 bytes. Repeated rows have equal ids, and no row is
dropped. Ties between pairs go to the left. Rows without ids decode to no bytes; an id that the file lacks is an error. Columns of the
input other than the text stay; the new ones take the names asked for. State: one step's pieces, a cache of at most CACHE pieces and one text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read, steps, unused

CHUNK, OVERLAP, STEP, LONG, CACHE = 32_768, 512, 4 << 20, 64, 400_000
#: Characters after a match that may decide it: its first is followed by two more in the pattern's longest fixed alternative.
LOOK = 2
_NONE = np.iinfo(np.int64).max
_LOADED: dict[tuple[str, str], Ranks] = {}


class Ranks:
    """A rank file and the pattern that goes with it, loaded once in each worker."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            rows = [line.split() for line in lines if line.strip()]
        self.bytes_of = {int(n): base64.b64decode(b) for b, n in rows}
        self.rank_of = {b: n for n, b in self.bytes_of.items()}
        self.pattern = regex.compile(pattern)
        size = max(self.bytes_of) + 1
        self.vocabulary = pa.array([self.bytes_of.get(i) for i in range(size)], pa.large_binary())
        self.single = np.array([self.rank_of[bytes([b])] for b in range(256)], np.int64)
        # Every way to put a token together from two others, by left * size + right.
        pairs = {}
        for b, n in self.rank_of.items():
            for k in range(1, len(b)):
                left, right = self.rank_of.get(b[:k]), self.rank_of.get(b[k:])
                if left is not None and right is not None:
                    pairs[left * size + right] = n
        self.size, self.pairs = size, pairs
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.ranks = np.append(keys, _NONE), np.array([*(pairs[k] for k in keys.tolist()), _NONE], np.int64)
        self.cache: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def of(path: str, pattern: str) -> Ranks:
        if (path, pattern) not in _LOADED:
            _LOADED[path, pattern] = Ranks(path, pattern)
        return _LOADED[path, pattern]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes; _NONE where it makes none."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def merged(self, pieces: np.ndarray) -> np.ndarray:
        """Ids of pieces of one length (a row each, by bytes), -1 after the last."""
        out = np.full(pieces.shape, -1, np.int64)
        whole, ids = np.arange(len(pieces)), self.single[pieces]
        rank = self.rank(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1 and len(ids):
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(ids)), at]
            over = least == _NONE
            if over.any():
                out[whole[over], : ids.shape[1]] = ids[over]
                whole, ids, rank, at, least = whole[~over], ids[~over], rank[~over], at[~over], least[~over]
            rows, last = np.arange(len(ids)), ids.shape[1] - 1
            moved = np.arange(last)[None] > at[:, None]
            left = np.where(moved, ids[:, 1:], ids[:, :-1])
            left[rows, at] = least
            rank = np.where(moved[:, :-1], rank[:, 1:], rank[:, :-1])
            ids = left
            for side in (at - 1, at):
                some = (side >= 0) & (side < last - 1)
                rank[rows[some], side[some]] = self.rank(ids[rows[some], side[some]], ids[rows[some], side[some] + 1])
        out[whole, : ids.shape[1]] = ids
        return out

    def merged_long(self, piece: bytes) -> list[int]:
        """Ids of one piece, with its pairs in a heap: the least rank first, of equal ones the leftmost."""
        ids: list[int] = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        get, size = self.pairs.get, self.size
        heap = [(r, i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := get(a * size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or get(ids[i] * size + ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if (s := get(r * size + ids[k])) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := get(ids[h] * size + r)) is not None:
                heapq.heappush(heap, (s, h))
        return [x for x in ids if x >= 0]

    def known(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Ids of each of some distinct pieces."""
        cache = self.cache
        new = [p for p in pieces if p not in cache]
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = pieces
        by: dict[int, list[tuple[str, bytes]]] = {}
        for p in new:
            raw = p.encode("utf-8", "surrogatepass")
            whole = self.rank_of.get(raw)
            if whole is not None:
                cache[p] = (whole,)
            elif len(raw) > LONG:
                cache[p] = tuple(self.merged_long(raw))
            else:
                by.setdefault(len(raw), []).append((p, raw))
        for n, own in by.items():
            found = self.merged(np.frombuffer(b"".join(raw for _, raw in own), np.uint8).reshape(-1, n))
            for (p, _), row, size in zip(own, found.tolist(), (found >= 0).sum(axis=1).tolist(), strict=True):
                cache[p] = tuple(row[:size])
        return [cache[p] for p in pieces]

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and how many each has."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        found = self.known(coded.dictionary.to_pylist())
        number = coded.indices.to_numpy().astype(np.int64)
        sizes = np.array([len(x) for x in found], np.int64)
        flat = np.array([i for x in found for i in x], np.uint32)
        each = sizes[number] if len(found) else np.zeros(0, np.int64)
        first = (np.cumsum(sizes) - sizes)[number] if len(found) else each
        return flat[np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())], each

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of the ids from each offset to the next."""
        tokens = self.vocabulary.take(pa.array(ids.astype(np.int64)))
        if tokens.null_count:
            raise ValueError("an id that the rank file lacks")
        _, ends, data = tokens.buffers()
        ends = np.frombuffer(ends, np.int64)[tokens.offset : tokens.offset + len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
        at = np.ascontiguousarray(ends[offsets] - ends[0])
        raw = data[int(ends[0]) : int(ends[-1])] if data is not None else pa.py_buffer(b"")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(at), raw])

    def step(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """ids and the offsets of each text among them; the lengths of each text's pieces in characters, and in ids."""
        pieces, count = [], [0]
        for t in texts:
            pieces += self.pattern.findall(t)
            count.append(len(pieces))
        ids, each = self.encoded(pieces)
        at = np.concatenate([[0], np.cumsum(each)])
        chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return ids, at[count], np.split(chars, count[1:-1]), np.split(each, count[1:-1])


class Chunk:
    """What a chunk has found: its place in the text, the starts of its pieces there, and their ids."""

    def __init__(self, number: int, chars: np.ndarray, each: np.ndarray, ids: np.ndarray, chunk: int):
        self.begin, self.ids = number * chunk, ids
        ends = self.begin + np.cumsum(chars)
        self.starts = ends - chars
        self.end = int(ends[-1]) if len(ends) else self.begin
        self.at = np.concatenate([[0], np.cumsum(each)])

    def part(self, start: int, stop: int) -> np.ndarray:
        """The ids of the pieces from one border to another."""
        a, b = np.searchsorted(self.starts, [start, stop])
        return self.ids[self.at[a] : self.at[b]]

    def text(self, ranks: Ranks, start: int) -> str:
        """The text from a place on."""
        whole = ranks.decoded(self.ids, np.array([0, len(self.ids)]))[0].as_py().decode("utf-8", "surrogatepass")
        return whole[start - self.begin :]


def stitched(ranks: Ranks, chunks: list[Chunk]) -> np.ndarray:
    """The ids of the text whose chunks these are, in order."""
    out, now, start = [], 0, 0
    while now + 1 < len(chunks):
        left, right = chunks[now], chunks[now + 1]
        sure = left.starts[: np.searchsorted(left.starts, left.end - LOOK, side="right")]
        own = sure[np.searchsorted(sure, max(start, right.begin)) :]
        common = np.intersect1d(own, right.starts, assume_unique=True)
        if len(common):
            out.append(left.part(start, int(common[0])))
            now, start = now + 1, int(common[0])
            continue
        # No border in the overlap: go on from the last true border, over twice as many characters each time.
        last = max(start, int(sure[-1]) if len(sure) else start)
        out.append(left.part(start, last))
        text, reach, found = [left.text(ranks, last)], now, None
        while found is None:
            goal = 2 * sum(map(len, text))
            while reach + 1 < len(chunks) and sum(map(len, text)) < goal:
                reach += 1
                text.append(chunks[reach].text(ranks, chunks[reach - 1].end))
            text = ["".join(text)]
            borders = np.unique(np.concatenate([c.starts[c.starts > last] for c in chunks[now + 1 : reach + 1]]))
            pieces, begin, final = [], last, reach + 1 == len(chunks)
            for m in ranks.pattern.finditer(text[0]):
                if m.end() > len(text[0]) - LOOK and not final:
                    break
                pieces.append(m[0])
                begin = last + m.end()
                k = int(np.searchsorted(borders, begin))
                if k < len(borders) and borders[k] == begin:
                    found = begin
                    break
            else:
                found = begin
            if pieces:
                out.append(ranks.encoded(pieces)[0])
                text, last = [text[0][begin - last :]], begin
        now = max(k for k in range(now + 1, reach + 1) if chunks[k].begin <= found)
        while found < chunks[now].end and not np.isin(found, chunks[now].starts):
            now -= 1
        start = found
    return np.concatenate([*out, chunks[now].part(start, chunks[now].end)]).astype(np.uint32)


def _bytes(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The ids from each offset to the next as little-endian unsigned 32-bit integers."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64) * 4), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())


def _finished(ranks: Ranks, ids: np.ndarray, offsets: np.ndarray, back: bool) -> list[pa.Array]:
    return [_bytes(ids, offsets), *([ranks.decoded(ids, offsets).cast(pa.binary())] if back else [])]


def encoded(docs: DataFrame, path: str, pattern: str, ids: str = "ids", back: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with a column of ids (little-endian unsigned 32-bit integers, as bytes); back: also one of the bytes that they decode to."""
    names = [c for c in docs.columns if c not in (ids, back)]
    docs = docs.select(*names)
    key, found, again = unused(docs, "_key", "_ids", "_back")
    ends = [(found, ids), *([(again, back)] if back else [])]
    kinds = ", ".join(f"`{c}` binary" for c, _ in ends)
    schema = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    short, long = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= chunk), docs.filter(F.length("text") > chunk)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        ranks = Ranks.of(path, pattern)
        for batch in steps(batches, limit=STEP):
            flat, at, _, _ = ranks.step(pc.fill_null(batch.column("text"), "").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *_finished(ranks, flat, at, back is not None)], names=[*batch.schema.names, *(c for c, _ in ends)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in steps(batches, limit=STEP):
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                starts = range(0, len(t), chunk)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(starts), pa.binary()), pa.array(range(len(starts)), pa.int32()), pa.array([t[s : s + chunk + overlap] for s in starts])], names=["key", "number", "text"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        ranks = Ranks.of(path, pattern)
        for batch in steps(batches, limit=STEP):
            flat, at, chars, each = ranks.step(batch.column("text").to_pylist())
            sizes = [pa.array([x.astype(np.int32).tobytes() for x in xs], pa.binary()) for xs in (chars, each)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("number"), *sizes, _bytes(flat, at)], names=["key", "number", "chars", "each", "ids"])

    def join(rows: pa.Table) -> pa.Table:
        lean()
        ranks = Ranks.of(path, pattern)
        rows = rows.sort_by("number")
        number = lambda cell: np.frombuffer(cell.as_buffer(), np.int32).astype(np.int64)
        chunks = [Chunk(n.as_py(), number(c), number(e), np.frombuffer(i.as_buffer(), "<u4"), chunk) for n, c, e, i in zip(*(rows.column(x) for x in ("number", "chars", "each", "ids")), strict=True)]
        flat = stitched(ranks, chunks)
        return pa.table([rows.column("key")[:1], *_finished(ranks, flat, np.array([0, len(flat)]), back is not None)], names=["key", *(c for c, _ in ends)])

    digest = F.unhex(F.sha2("text", 256))
    done = short.mapInArrow(whole, f"{schema(docs)}, {kinds}")
    dealt = long.select(digest.alias("key"), "text").mapInArrow(cut, "key binary, number int, text string").dropDuplicates(["key", "number"])
    met = dealt.mapInArrow(pieces, "key binary, number int, chars binary, each binary, ids binary").groupBy("key").applyInArrow(join, f"key binary, {kinds}")
    joined = long.withColumn(key, digest).join(met.withColumnRenamed("key", key + "_"), F.col(key) == F.col(key + "_"))
    out = done.unionByName(joined.select(*names, *(c for c, _ in ends)))
    return out.withColumnsRenamed(dict(ends))


def decoded(rows: DataFrame, path: str, pattern: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """rows with the bytes that a column of ids, as encoded() makes it, decodes to."""
    rows = rows.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        ranks = Ranks.of(path, pattern)
        for batch in steps(batches, ids, STEP):
            own = pc.fill_null(batch.column(ids), b"").cast(pa.large_binary())
            at = np.concatenate([[0], np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False))]) // 4
            flat = np.frombuffer(b"".join(own.to_pylist()), "<u4")
            yield pa.RecordBatch.from_arrays([*batch.columns, ranks.decoded(flat, at).cast(pa.binary())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{name}` binary")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, back="decoded")
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
