"""Language-model scores from a probabilistic suffix tree over words, its contexts as long as the corpus supports.

States are contexts: the empty one, and sequences of preceding words of one document. A context s is *considered* when it
occurs MIN_CONTEXT times in training, is one word or the context without its first word is kept and the one without its
last word is considered. It is *kept* when some next token tells it from its suffix (s without its first word): seen twice
or more after it, with count * ln(P(token | s) / P(token | suffix)) of at least DIVERGENCE. So with a state all its
suffixes are states, and depth has no limit but these tests. A state's distribution is smoothed with its suffix's,
(count + SMOOTH * P(token | suffix)) / (count of s + SMOOTH), the empty context's is (count + 1) / (tokens + distinct tokens
+ 1), which leaves the last share to any unknown token. A token is scored at the longest state that ends before it.

The tree grows with the corpus, so nothing of it goes to the driver or to every task. Texts become chunks of word numbers in
the shared folder. Level by level, every chunk asks for just the counts it needs: its distinct keys (64-bit hashes of word
sequences) in one block for each bucket; a bucket adds up the blocks and answers each chunk in the order asked. With
the sequences of level k a chunk asks which contexts of level k - 1 are kept; chunks that see a telling token say so. The
passes end when no chunk has anything left to ask. A key, however frequent, is once in each block. From level REPLAYED on
few places are left, and a chunk's state is stored instead of being worked out again from its words and answers.

Null texts are empty: one token, the end. A row without doc_id belongs to training. Repeated rows count each. A very long text
is a chunk of its own. Other columns are not read. State: one chunk, or the blocks of a bucket; buckets grow with the input.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_WORDS_LOWER, dropped, lean, mixed, read, steps, words, written

MIN_CONTEXT, DIVERGENCE, SMOOTH = 8, 6.0, 8.0
CHUNK_BYTES, BUCKET_BYTES, REPLAYED = 6 << 20, 16 << 20, 4
END = np.uint64(0x5E17D0F7E27A1C3B)
_NEXT, _FLAG = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_QUESTION = "bucket int, chunk long, keys binary, counts binary"
_ANSWER = "chunk long, pass int, bucket int, data binary, total long, seen long"


def _shrunk(values: np.ndarray) -> bytes:
    """Numbers in byte planes, so that what is regular in them is compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _grown(data: bytes, kind: np.dtype | type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def _packed(arrays: dict[str, np.ndarray], **others: object) -> bytes:
    return pickle.dumps(({k: (v.dtype.str, _shrunk(v)) for k, v in arrays.items()}, others))


def _unpacked(data: bytes) -> tuple[dict[str, np.ndarray], dict]:
    arrays, others = pickle.loads(data)
    return {k: _grown(v, np.dtype(kind)) for k, (kind, v) in arrays.items()}, others


def _order(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in ascending order, and where each bucket's begin; a bucket is a range of keys."""
    order = np.argsort(keys)
    return order, np.searchsorted(keys[order], np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)).tolist() + [len(keys)]


def asked(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    order, at = _order(keys, buckets)
    own = np.flatnonzero(np.diff(at)).tolist()
    parts = [order[at[b] : at[b + 1]] for b in own]
    columns = [pa.array(own, pa.int32()), pa.array([chunk] * len(own), pa.int64()), pa.array([_shrunk(np.diff(keys[p], prepend=np.uint64(0))) for p in parts], pa.binary()), pa.array([_shrunk(counts[p].astype(np.uint32)) for p in parts], pa.binary())]
    return pa.table(columns, names=["bucket", "chunk", "keys", "counts"])


def answered(keys: np.ndarray, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    order, at = _order(keys, buckets)
    out = np.zeros(len(keys), np.int64)
    for b, data in answers.items():
        out[order[at[b] : at[b + 1]]] = _grown(data, np.int64)
    return out


def added(blocks: pa.Table, number: int) -> pa.Table:
    """One bucket: the sum of each key over all blocks, put back in each block's order."""
    lean()
    rows = blocks.num_rows
    keys = [np.cumsum(_grown(x.as_py(), np.uint64), dtype=np.uint64) for x in blocks.column("keys")]
    counts = np.concatenate([_grown(x.as_py(), np.uint32) for x in blocks.column("counts")])
    place, distinct = pd.factorize(np.concatenate(keys))
    sums = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    data = [_shrunk(sums[p]) for p in np.split(place, ends[:-1])]
    return pa.table({
        "chunk": blocks.column("chunk"), "pass": pa.array([number] * rows, pa.int32()), "bucket": blocks.column("bucket"), "data": pa.array(data, pa.binary()),
        "total": pa.array([int(sums.sum())] + [0] * (rows - 1)), "seen": pa.array([int((sums > 0).sum())] + [0] * (rows - 1)),
    })


def _used(ids: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in a table without the entries that none of them names."""
    mark = np.zeros(len(table), bool)
    mark[ids] = True
    return (np.cumsum(mark, dtype=np.int32) - 1)[ids], table[mark]


class Walk:
    """The places of a chunk whose context may still grow, and what is known of its rows.

    Of each place: its word, the sequence of context and word that ends with it (`gram`) and that one's count, its context, whether
    the word tells that context from its suffix, and P(word) at the suffix and at the context. Words, grams and contexts are
    numbers in tables of their hashes.
    """

    TABLES = ("word", "gram", "context")

    def __init__(self, level: int, places: dict[str, np.ndarray], tables: dict[str, np.ndarray], rows: dict[str, np.ndarray]):
        self.level, self.places, self.tables, self.rows = level, places, tables, rows

    @staticmethod
    def begun(tokens: dict[str, np.ndarray], held: np.ndarray) -> Walk:
        n = np.diff(tokens["offsets"])
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        depth = (np.arange(len(row)) - np.repeat(tokens["offsets"][:-1], n)).astype(np.int32)
        places = {"at": np.arange(len(row), dtype=np.int32), "row": row, "depth": depth, "train": ~held[row], "word": tokens["codes"], "gram": tokens["codes"]}
        return Walk(0, places, {"word": tokens["vocabulary"], "gram": tokens["vocabulary"]}, {"n_tokens": n})

    def question(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, and what this chunk adds to each."""
        x, tables = self.places, self.tables
        if self.level == 0:
            self.codes, self.sequences = x["word"], tables["word"]
            return self.sequences, np.bincount(self.codes[x["train"]], minlength=len(self.sequences))
        follows = (x["at"][1:] == x["at"][:-1] + 1) & (x["depth"][1:] >= self.level) & (x["count"][:-1] >= MIN_CONTEXT)
        self.some = np.flatnonzero(follows) + 1
        with np.errstate(over="ignore"):
            grams = mixed(tables["gram"][x["gram"][self.some - 1]] * _NEXT + tables["word"][x["word"][self.some]] + np.uint64(self.level))
        self.codes, self.sequences = pd.factorize(grams)
        counts = np.bincount(self.codes[x["train"][self.some]], minlength=len(self.sequences))
        if self.level == 1:
            return self.sequences, counts
        self.flags, contexts = _used(x["context"], tables["context"])
        told = np.zeros(len(contexts), np.int64)
        told[self.flags[x["tells"]]] = 1
        return np.concatenate([self.sequences, mixed(contexts ^ _FLAG)]), np.concatenate([counts, told])

    def learn(self, values: np.ndarray, tokens: int, seen: int) -> None:
        """Take the answers to the last question, settle the places whose longest state is known, go on with the others."""
        x, rows = self.places, self.rows
        if self.level == 0:
            p = (values + 1) / (tokens + seen + 1)
            x["count"], x["near"] = values[self.codes], p[self.codes]
            x["safe"] = x["near"]
            total = lambda w: np.bincount(x["row"], weights=w[self.codes], minlength=len(rows["n_tokens"]))
            rows["n_known"], rows["base"] = total(values > 0).astype(np.int64), total(np.log10(p))
            rows["score"], rows["n_long"] = np.zeros(len(rows["n_tokens"])), np.zeros(len(rows["n_tokens"]), np.int64)
        else:
            kept = np.ones(len(x["at"]), bool) if self.level == 1 else values[len(self.sequences) :][self.flags] > 0
            goes = np.zeros(len(kept), bool)
            goes[self.some] = kept[self.some]
            ends = np.flatnonzero(~goes)
            settled, sure = x["row"][ends], kept[ends]
            rows["score"] += np.bincount(settled, weights=np.log10(np.where(sure, x["near"][ends], x["safe"][ends])), minlength=len(rows["score"]))
            rows["n_long"] += np.bincount(settled[self.level - 1 - ~sure >= 2], minlength=len(rows["score"]))
            on = np.flatnonzero(goes[self.some])
            new, codes = self.some[on], self.codes[on]
            before = new - 1
            count, suffix, times = values[codes], x["near"][new], x["count"][before]
            twice = np.flatnonzero(count >= 2)
            tells = np.zeros(len(on), bool)
            tells[twice] = count[twice] * np.log(count[twice] / (times[twice] * suffix[twice])) >= DIVERGENCE
            same = {k: x[k][new] for k in ("at", "row", "depth", "train", "word")}
            self.places = {**same, "gram": codes, "count": count, "context": x["gram"][before], "tells": tells, "safe": suffix, "near": (count + SMOOTH * suffix) / (times + SMOOTH)}
            self.tables = {"word": self.tables["word"], "gram": self.sequences, "context": self.tables["gram"]}
        self.level += 1

    def state(self) -> tuple[dict[str, np.ndarray], dict]:
        for k in self.TABLES:
            self.places[k], self.tables[k] = _used(self.places[k], self.tables[k])
        parts = {"p": self.places, "t": self.tables, "r": self.rows}
        return {f"{part}_{k}": v for part, own in parts.items() for k, v in own.items()}, {"level": self.level}

    @staticmethod
    def of(arrays: dict[str, np.ndarray], others: dict) -> Walk:
        return Walk(others["level"], *({k[2:]: v for k, v in arrays.items() if k[0] == part} for part in "ptr"))


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def chunks(docs: DataFrame) -> DataFrame:
    """The texts as chunks of word numbers, as rows like the answers'; total: bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lean()
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for k, batch in enumerate(steps(batches, limit=CHUNK_BYTES)):
            w = words(batch.column("text"), BLANK_WORDS_LOWER)
            offsets = np.concatenate([[0], np.cumsum(w.counts + 1)])
            codes = np.full(offsets[-1], len(w.vocabulary), np.int32)
            inner = np.ones(len(codes), bool)
            inner[offsets[1:] - 1] = False
            codes[inner] = w.codes
            data = _packed({"codes": codes, "offsets": offsets, "vocabulary": np.append(w.hashes(), END)}, rows=_ipc(batch.select(["doc_id", "held_out"])))
            yield pa.RecordBatch.from_arrays([pa.array([base + k]), pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([data], pa.binary()), pa.array([batch.column("text").nbytes]), pa.array([0])], names=["chunk", "pass", "bucket", "data", "total", "seen"])

    return docs.mapInArrow(run, _ANSWER)


def _walked(group: pa.Table, buckets: int, tokens: int, seen: int) -> tuple[Walk, bytes]:
    """A chunk's walk with all its answers learnt, and its rows' doc_id and held_out."""
    answers: dict[int, dict[int, bytes]] = {}
    data = b""
    for number, bucket, x in zip(group.column("pass").to_pylist(), group.column("bucket").to_pylist(), group.column("data"), strict=True):
        if number < 0:
            data = x.as_py()
        else:
            answers.setdefault(number, {})[bucket] = x.as_py()
    arrays, others = _unpacked(data)
    if "level" in others:
        walk = Walk.of(arrays, others)
    else:
        held = pa.ipc.open_stream(others["rows"]).read_next_batch().column("held_out")
        walk = Walk.begun(arrays, np.array(held.to_pylist(), bool))
    for number in range(walk.level, max(answers, default=-1) + 1):  # a level without answers is one without questions
        keys, _ = walk.question()
        walk.learn(answered(keys, answers.get(number, {}), buckets), tokens, seen)
    return walk, others["rows"]


def scored(docs: DataFrame) -> DataFrame:
    """Scores of each row of docs(doc_id, text, held_out), learnt from those that are not held out."""
    state = written(chunks(docs.select("doc_id", "text", "held_out")), "chunks")
    size = state.agg(F.sum("total")).first()[0] or 0
    buckets = max(64, size // BUCKET_BYTES)
    kept, tokens, seen = [state], 0, 0

    def every() -> DataFrame:
        rows = kept[0]
        for more in kept[1:]:
            rows = rows.unionByName(more)
        return rows.groupBy("chunk")

    def adder(level: int) -> Callable[[pa.Table], pa.Table]:
        return lambda group: added(group, level)

    def asker(n: int, v: int) -> Callable[[pa.Table], pa.Table]:
        def ask(group: pa.Table) -> pa.Table:
            lean()
            walk, _ = _walked(group, buckets, n, v)
            return asked(group.column("chunk")[0].as_py(), *walk.question(), buckets)

        return ask

    for level in range(REPLAYED):
        kept.append(written(every().applyInArrow(asker(tokens, seen), _QUESTION).groupBy("bucket").applyInArrow(adder(level), _ANSWER), "answers"))
        if level == 0:
            found = kept[1].agg(F.sum("total"), F.sum("seen")).first()
            tokens, seen = found[0] or 0, found[1] or 0

    n, v = tokens, seen
    stored = f"{_QUESTION}, pass int, data binary"

    def store(group: pa.Table) -> pa.Table:
        """The chunk's state as a row like the answers', and its question."""
        lean()
        walk, rows = _walked(group, buckets, n, v)
        chunk = group.column("chunk")[0].as_py()
        arrays, others = walk.state()
        keys, counts = walk.question()
        own = pa.table({"bucket": pa.array([-1], pa.int32()), "chunk": pa.array([chunk]), "keys": pa.array([None], pa.binary()), "counts": pa.array([len(keys).to_bytes(8, "little")], pa.binary()), "pass": pa.array([-1], pa.int32()), "data": pa.array([_packed(arrays, rows=rows, **others)], pa.binary())})
        return pa.concat_tables([own, asked(chunk, keys, counts, buckets)], promote_options="default")

    level = REPLAYED
    while True:
        table = written(every().applyInArrow(store, stored), "states")
        for old in kept:
            dropped(old)
        kept = [table.filter("bucket < 0").select("chunk", "pass", "bucket", "data", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("seen"))]
        questions = table.filter("bucket >= 0").select("bucket", "chunk", "keys", "counts")
        if questions.isEmpty():
            break
        answers = written(questions.groupBy("bucket").applyInArrow(adder(level), _ANSWER), "answers")
        kept.append(answers)
        level += 1
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for data in batch.column("data"):
                arrays, others = _unpacked(data.as_py())
                walk, rows = Walk.of(arrays, others), pa.ipc.open_stream(others["rows"]).read_next_batch()
                walk.question()
                walk.learn(np.zeros(0, np.int64), n, v)  # no chunk has a question left
                r = walk.rows
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(r["n_tokens"]), pa.array(r["n_known"]), pa.array([n] * len(r["base"]), pa.int64()), pa.array(r["base"]), pa.array(r["score"]), pa.array(r["n_long"])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_long"])

    return kept[0].select("data").mapInArrow(scores, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_long long")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


def op2_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scored(docs.select("doc_id", "text", held_out().alias("held_out")))
