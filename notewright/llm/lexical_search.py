"""Ranked lexical search by variable-block-max WAND over a document-partitioned index.

A shard is a run of at most SHARD_DOCS documents of one task. It holds, for each term that is asked for, a posting list (document,
occurrences), documents numbered by ascending doc_id. Nothing is shuffled for it: a shard is one row of a table, made in one scan of the
texts, which also counts the documents, their terms and each asked term's documents. With these the integer share of every
posting is fixed, and dynamic programming cuts each list into blocks: of all cuts into blocks of at most LONGEST postings it takes the
one with the least sum, over the blocks, of their bound error (length * greatest share - sum of shares) plus FIXED for each block. All lists of a shard
advance together, one posting a step.

A search looks at one shard and one query. The borders of the blocks of the query's lists cut the documents into ranges, and the sum of
the greatest shares of the blocks over a range, times their terms' weights, bounds the score of each document in it. Ranges are opened
highest bound first; once k documents are known, a range whose bound is under the k-th score is skipped with all that follow, and so are
blocks that reach into no open range. Within an open range a document is a pivot only if the bounds of the blocks that really hold
it reach the k-th score (the weak AND); pivots alone are scored, so what is returned is exact, ties by ascending doc_id included. Each
shard gives k documents a query at most, and the best of these are ranked in Spark.

Queries are dealt into blocks of about QUERY_BYTES of text, whose terms go to the workers; each block scans the documents once. Of the
documents' own values only doc_id and text are read. Null and empty texts have no term, are not counted and never found; a query
without terms or without a match has no rows. Repeated documents are found each; rows with equal doc_id and score are interchangeable, and a
null doc_id comes after all others. Repeated items are answered each; items that share an id but not the text are separate
queries. A very long text is a document like any other. Without documents or items there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import ALNUM_WORDS_LOWER, dropped, lean, read, steps, words, written

TOP, SHARD_DOCS, SHARD_POSTINGS, QUERY_BYTES = 10, 16_384, 4 << 20, 16 << 20
LONGEST, FIXED = 64, 2_000_000
DOCS_OF, WORDS_OF = -1, -2
_FAR = np.iinfo(np.int64).max


def texts_as_terms(texts: list[str | None]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct terms of some queries, and the codes of each query's own."""
    w = words(pa.array(texts, pa.string()), ALNUM_WORDS_LOWER)
    return w.vocabulary, [np.unique(w.codes[a:b]) for a, b in zip(w.offsets, w.offsets[1:], strict=False)]


class _Shard:
    """Collects the postings of a run of documents."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.found, self.docs, self.postings = [], [], [], 0, 0

    def add(self, ids: pa.Array, texts: pa.Array, terms: pa.Array) -> None:
        w = words(texts, ALNUM_WORDS_LOWER)
        code = pc.fill_null(pc.index_in(w.vocabulary, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)[w.codes]
        asked = code >= 0
        some = w.counts > 0
        number = self.docs + np.cumsum(some) - 1
        pair, times = np.unique(number[w.owners()[asked]] << 32 | code[asked], return_counts=True)
        self.ids.append(ids.filter(pa.array(some)))
        self.sizes.append(w.counts[some])
        self.found.append((pair >> 32, pair & 0xFFFFFFFF, times))
        self.docs += int(some.sum())
        self.postings += len(pair)

    def row(self) -> pa.RecordBatch:
        """One row; documents in the order of their ids, postings by term and document."""
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc, code, times = (np.concatenate(x) for x in zip(*self.found, strict=True))
        doc = place[doc]
        by = np.lexsort((doc, code))
        terms, first = np.unique(code[by], return_index=True)
        sizes = np.concatenate(self.sizes)[order].astype(np.int64)
        ends = np.append(first[1:], len(by))[: len(terms)]
        blob = [x.tobytes() for x in (sizes, terms.astype(np.int32), ends.astype(np.int64), doc[by].astype(np.int32), times[by].astype(np.int32))]
        return pa.RecordBatch.from_arrays([_one(ids.take(pa.array(order))), *(pa.array([x], pa.binary()) for x in blob)], names=["ids", "sizes", "terms", "ends", "docs", "times"])


def _one(x: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def postings(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """A row for each shard of docs(doc_id, text): ids, and as bytes sizes (terms of each document), terms, ends, docs, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        shard = _Shard()
        for batch in batches:
            for step in steps(iter([batch])):
                for start in range(0, step.num_rows, SHARD_DOCS):
                    part = step.slice(start, SHARD_DOCS)
                    if shard.docs and (shard.docs + part.num_rows > SHARD_DOCS or shard.postings > SHARD_POSTINGS):
                        yield shard.row()
                        shard = _Shard()
                    shard.add(part.column("doc_id"), part.column("text"), terms)
        if shard.docs:
            yield shard.row()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"ids array<{kind}>, sizes binary, terms binary, ends binary, docs binary, times binary")


def _numbers(cell: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def statistics(shards: DataFrame) -> dict[int, int]:
    """How many documents hold each term (by code), how many there are, and how many terms they have: a few numbers for each asked term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {DOCS_OF: 0, WORDS_OF: 0}
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, terms, ends = (_numbers(batch.column(c)[i], t) for c, t in (("sizes", np.int64), ("terms", np.int32), ("ends", np.int64)))
                total[DOCS_OF] += len(sizes)
                total[WORDS_OF] += int(sizes.sum())
                for t, n in zip(terms.tolist(), np.diff(ends, prepend=0).tolist(), strict=True):
                    total[t] = total.get(t, 0) + n
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    counted = shards.select("sizes", "terms", "ends").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counted.collect()}


def shares(sizes: np.ndarray, docs: np.ndarray, times: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """The share of each posting in its document's score, before the term's weight."""
    wide = np.int64 if 90 * int(sizes.max(initial=0)) * n_docs < 2**62 else object
    length = (10 + 90 * sizes.astype(wide) * n_docs // max(n_words, 1)).astype(np.int64)
    times = times.astype(np.int64)
    return 1_000_000_000 * times // (1_000 * times + 8 * length[docs])


def blocks_of(share: np.ndarray, ends: np.ndarray, longest: int = LONGEST, fixed: int = FIXED) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the blocks of all lists, in order, and how many blocks there are up to the end of each list.

    cost(i) = min over k of cost(i - k) + k * (greatest of the last k shares) + fixed; the sum of shares is the same for any cut.
    """
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    size = ends - starts
    by = np.argsort(-size, kind="stable")
    first, size = starts[by], size[by]
    back = np.ones(len(share), np.int64)
    lengths = np.arange(1, longest + 1)
    most = np.zeros((len(by), longest), np.int64)
    cost = np.full((len(by), longest), _FAR // 4)
    cost[:, 0] = 0
    for i in range(int(size.max(initial=0))):
        alive = int(np.searchsorted(-size, -i, side="left"))
        most, cost = most[:alive], cost[:alive]
        new = share[first[:alive] + i]
        most[:, 1:] = most[:, :-1]
        most[:, 0] = 0
        np.maximum(most, new[:, None], out=most)
        total = cost + most * lengths
        k = total.argmin(axis=1)
        back[first[:alive] + i] = k + 1
        cost[:, 1:] = cost[:, :-1]
        cost[:, 0] = total[np.arange(alive), k] + fixed
    cuts, at = [], ends.copy()
    while True:
        left = at > starts
        if not left.any():
            break
        cuts.append(at[left])
        at = np.where(left, at - back[np.maximum(at - 1, 0)], at)
    cut = np.sort(np.concatenate(cuts)) if cuts else np.zeros(0, np.int64)
    return cut, np.searchsorted(cut, ends, side="right")


def blocked(shards: DataFrame, n_docs: int, n_words: int) -> DataFrame:
    """The index: ids, terms, ends, docs as they were, share (of each posting), cuts (ends of blocks) and upto (blocks by list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                sizes, ends, docs, times = (_numbers(row.column(c)[0], t) for c, t in (("sizes", np.int64), ("ends", np.int64), ("docs", np.int32), ("times", np.int32)))
                share = shares(sizes, docs, times, n_docs, n_words)
                cuts, upto = blocks_of(share, ends)
                made = [pa.array([x.tobytes()], pa.binary()) for x in (share.astype(np.int32), cuts.astype(np.int64), upto.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("ids", "terms", "ends", "docs")), *made], names=["ids", "terms", "ends", "docs", "share", "cuts", "upto"])

    kind = shards.schema["ids"].dataType.simpleString()
    return shards.mapInArrow(run, f"ids {kind}, terms binary, ends binary, docs binary, share binary, cuts binary, upto binary")


class Index:
    """One shard's lists and blocks, read where they lie."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda c, t: _numbers(batch.column(c)[i], t)
        self.terms, self.ends, self.docs, self.share = get("terms", np.int32), get("ends", np.int64), get("docs", np.int32), get("share", np.int32)
        self.cuts, self.upto = get("cuts", np.int64), get("upto", np.int64)
        self.begin = np.concatenate([[0], self.cuts[:-1]])[: len(self.cuts)]
        self.tops = np.maximum.reduceat(self.share, self.begin).astype(np.int64) if len(self.cuts) else np.zeros(0, np.int64)
        self.low, self.high = self.docs[self.begin].astype(np.int64), self.docs[self.cuts - 1].astype(np.int64)
        self.size = len(batch.column("ids")[i])

    def lists(self, codes: np.ndarray) -> np.ndarray:
        """Places of the shard's lists among some terms; a term without one is left out."""
        at = np.searchsorted(self.terms, codes)
        inside = at < len(self.terms)
        at, codes = at[inside], codes[inside]
        return at[self.terms[at] == codes]


def best(index: Index, codes: np.ndarray, weights: np.ndarray, k: int = TOP) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents (by number) and scores of the k best with a score above 0, in order, and the number of postings read."""
    at = index.lists(codes)
    first = np.concatenate([[0], index.upto[:-1]])[: len(index.upto)][at]
    count = index.upto[at] - first
    block = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    weight = np.repeat(weights[index.terms[at]], count)
    bound = weight * index.tops[block]
    low, high = index.low[block], index.high[block] + 1
    # Ranges between borders of blocks, with the sum of the bounds over each.
    border, change = np.unique(np.concatenate([low, high]), return_inverse=True)
    step = np.zeros(len(border), np.int64)
    np.add.at(step, change, np.concatenate([bound, -bound]))
    over = np.cumsum(step)[:-1]
    order = np.argsort(-over, kind="stable")
    order = order[over[order] > 0]
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = np.diff(border)[order]
    done, budget, seen = 0, 8 * k, 0
    while done < len(order):
        least = int(scores[k - 1]) if len(scores) >= k else 1
        stop = int(np.searchsorted(-over[order], -least, side="right"))
        if stop <= done:
            break
        until = min(stop, done + 1 + int(np.searchsorted(np.cumsum(width[done:stop]), budget)))
        chosen = order[done:until]
        edge = np.zeros(index.size + 1, np.int64)
        edge[border[chosen]] += 1
        np.subtract.at(edge, border[chosen + 1], 1)
        open_ = np.cumsum(edge)[:-1] > 0
        inside = np.concatenate([[0], np.cumsum(open_)])
        used = inside[high] > inside[low]
        a, n = index.begin[block[used]], index.cuts[block[used]] - index.begin[block[used]]
        row = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        doc = index.docs[row]
        seen += len(row)
        here = open_[doc]
        row, doc, of = row[here], doc[here], np.repeat(np.flatnonzero(used), n)[here]
        hope = np.zeros(index.size, np.int64)
        np.add.at(hope, doc, bound[of])
        pivot = (hope >= least)[doc]
        score = np.zeros(index.size, np.int64)
        np.add.at(score, doc[pivot], weight[of[pivot]] * index.share[row[pivot]])
        new = np.flatnonzero(score)
        docs, scores = np.concatenate([docs, new]), np.concatenate([scores, score[new]])
        keep = np.lexsort((docs, -scores))[:k]
        docs, scores, done, budget = docs[keep], scores[keep], until, 32 * budget
    return docs, scores, seen


def searched(index: DataFrame, queries: list[np.ndarray], weights: np.ndarray, k: int = TOP) -> DataFrame:
    """query (its place), doc_id, score: the k best of each shard. queries: codes of each one's terms; weights: by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for i in range(batch.num_rows):
                shard, of, docs, scores = Index(batch, i), [], [], []
                for q, codes in enumerate(queries):
                    d, s, _ = best(shard, codes, weights, k)
                    of.append(np.full(len(d), q, np.int32))
                    docs.append(d)
                    scores.append(s)
                if of:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(of)), batch.column("ids")[i].values.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))], names=["query", "doc_id", "score"])

    kind = index.schema["ids"].dataType.elementType.simpleString()
    return index.mapInArrow(run, f"query int, doc_id {kind}, score long")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best rows of docs(doc_id, text) for each row of items(item_id, text)."""
    spark = docs.sparkSession
    asked = items.select("item_id", "text").groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    size = asked.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_blocks, out = 1 + size // QUERY_BYTES, None
    for b in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()
        terms, queries = texts_as_terms([r["text"] for r in rows])
        shards = written(postings(docs, terms), "postings")
        n = statistics(shards)
        index = written(blocked(shards, n.get(DOCS_OF, 0), n.get(WORDS_OF, 0)), "blocks")
        dropped(shards)
        weights = np.array([weight(n.get(DOCS_OF, 0), n.get(t, 0)) for t in range(len(terms))], np.int64)
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        found = searched(index, queries, weights, k).withColumn("rank", place).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(q, r["item_id"], r["copies"]) for q, r in enumerate(rows)], f"_q int, item_id {items.schema['item_id'].dataType.simpleString()}, _copies long")
        found = found.join(F.broadcast(names), F.col("query") == F.col("_q")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
        found = found.select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_words FROM d WHERE len(w) > 0),
b AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS w FROM benchmark),
asked AS (SELECT q, unnest(w) AS t FROM b),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY r, t),
weight AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, n_docs),
share AS (SELECT r, t, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * n_docs) // n_words)) AS s FROM tf JOIN d USING (r), total),
scored AS (SELECT q, r, sum(w * s)::BIGINT AS score FROM asked JOIN share USING (t) JOIN weight USING (t) GROUP BY q, r)
SELECT item_id, rank, doc_id, score
FROM (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scored JOIN d USING (r) JOIN b USING (q) WHERE score > 0)
WHERE rank <= {TOP}
"""
