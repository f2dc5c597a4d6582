"""Substring deduplication by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. Its minimiser is the leftmost of its smallest GRAM-word hashes, so
equal windows have equal minimisers at equal offsets. Consecutive windows that share a minimiser's place travel as one
packed string to the bucket of the minimiser's hash, one compressed block for each step and bucket, equal strings of a step
once with the list of their places. A bucket thus gets every occurrence of each of its windows. There, strings that occur
twice repeat wholly, minimisers seen once are done, and the windows of the others are sorted, so that equal ones stand
together: counts are exact and compare the words themselves. What goes back is (document, word range), joined to the texts.

A GRAM-word sequence that many documents share would send all their windows around it to one bucket. So a first pass finds the
frequent ones: each step gives those that make up over SHARE / 2 of its grams, and those that are over SHARE / 2 of all
grams in sum (at most 2 / SHARE of them, none of over SHARE is missed) are a window's minimiser only if it holds nothing else.
Windows within a shared passage are then equal strings, once in each step's block; those that reach out of it go elsewhere.

A word is removed when a window that covers it starts anywhere else too, judged on the input. Null and empty texts have no
words. Repeated rows repeat their windows, so long ones lose all words. Rows are told apart by doc_id and text; rows equal
in both have equal results. Texts of fewer than WINDOW words stay whole. Of equal smallest hashes the leftmost is the minimiser.
A very long text is a step of its own. Other columns stay, whatever their names, but for n_words and n_removed.
State: one step's strings, and one bucket's; the number of buckets follows the size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK_WORDS, dropped, grams, joined, lean, partitions, read, steps, unused, words, written

WINDOW, GRAM, PLACE_BITS = 35, 4, 28
SHARE, LEAST, STEP, BUCKET_BYTES = 1 / 20_000, 64, 4 << 20, 16 << 20
_NONE = np.zeros(0, np.uint64)
_ENTRY = np.dtype([("minimiser", "<u8"), ("uses", "<u4")])
_PLACE = np.dtype([("key", "<i8"), ("text", "<i4"), ("start", "<u4")])


def minimisers(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM, frequent: np.ndarray = _NONE) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the word hashes: the place of its minimiser, and all gram hashes; frequent (sorted) grams come last."""
    g = grams(hashes, gram)
    places = np.uint64((1 << PLACE_BITS) - 1)
    rank = g >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)
        rank |= (frequent[at] == g).astype(np.uint64) << np.uint64(63)
    low = (rank & ~places) | np.arange(len(g), dtype=np.uint64)
    width, done = window - gram + 1, 1
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    return (low & places).astype(np.int64), g


def super_kmers(hashes: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM, frequent: np.ndarray = _NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, and minimiser hash of each run of windows with one minimiser place."""
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, g = minimisers(hashes, window, gram, frequent)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = owner[: len(at)] == owner[window - 1 :]
    new = whole.copy()
    new[1:] &= ~(whole[:-1] & (at[1:] == at[:-1]) & (owner[1 : len(at)] == owner[: len(at) - 1]))
    first = np.flatnonzero(new)
    total = np.concatenate([[0], np.cumsum(whole)])
    ends = np.append(first[1:], len(at))
    return first, total[ends] - total[first], g[at[first]]


def packed(batch: pa.RecordBatch, buckets: int, window: int, frequent: np.ndarray = _NONE) -> Iterator[tuple]:
    """(bucket, strings, entries, places) blocks of a step of (key, text hash, text)."""
    w = words(batch.column("text"), BLANK_WORDS)
    if not len(w.codes):
        return
    first, count, minimiser = super_kmers(w.hashes()[w.codes], w.offsets, window, GRAM, frequent)
    if not len(first):
        return
    flat = w.vocabulary.take(pa.array(w.codes))
    starts = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False) + 1)])
    line = joined(np.array([0, len(flat)], np.int64), flat)[0].as_buffer().to_pybytes()
    owner = np.searchsorted(w.offsets, first, side="right") - 1
    places = np.zeros(len(first), _PLACE)
    places["key"] = batch.column("key").to_numpy(zero_copy_only=False)[owner]
    places["text"] = batch.column("hash").to_numpy(zero_copy_only=False)[owner]
    places["start"] = first - w.offsets[owner]
    bucket = (minimiser % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    begin, end = starts[first].tolist(), (starts[first + count + window - 1] - 1).tolist()
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        by: dict[bytes, list[int]] = {}
        for i in order[a:b].tolist():
            by.setdefault(line[begin[i] : end[i]], []).append(i)
        entries = np.zeros(len(by), _ENTRY)
        entries["minimiser"] = minimiser[[own[0] for own in by.values()]]
        entries["uses"] = [len(own) for own in by.values()]
        used = places[[i for own in by.values() for i in own]]
        yield int(bucket[order[a]]), _shrunk(b"\n".join(by)), _shrunk(entries.tobytes()), _shrunk(used.tobytes())


def _shrunk(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _grown(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def repeated_windows(strings: list[bytes], window: int) -> list[np.ndarray]:
    """For distinct strings of one minimiser: which of the windows of each stand in another too, by sorting all windows."""
    every, bounds = [], []
    for number, s in enumerate(strings):
        gaps = [-1, *np.flatnonzero(np.frombuffer(s, np.uint8) == 32).tolist(), len(s)]
        bounds.append(len(gaps) - window)
        every += [(s[gaps[j] + 1 : gaps[j + window]], number, j) for j in range(bounds[-1])]
    every.sort()
    out = [np.zeros(n, bool) for n in bounds]
    for (s, a, i), (t, b, j) in zip(every, every[1:], strict=False):
        if s == t:
            out[a][i] = out[b][j] = True
    return out


def counted(blocks: pa.Table, window: int) -> pa.Table:
    """The repeated word ranges of one bucket, for each place: key, hash, a, b."""
    texts, entries, places = [], [], []
    for s, e, p in zip(*(blocks.column(c) for c in ("strings", "entries", "places")), strict=True):
        texts += _grown(s.as_py()).split(b"\n")
        entries.append(np.frombuffer(_grown(e.as_py()), _ENTRY))
        places.append(np.frombuffer(_grown(p.as_py()), _PLACE))
    entry, place = np.concatenate(entries), np.concatenate(places)
    coded = pa.array(texts, pa.large_binary()).dictionary_encode()
    number, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    uses = np.bincount(number, weights=entry["uses"]).astype(np.int64)
    minimiser = np.zeros(len(distinct), np.uint64)
    minimiser[number] = entry["minimiser"]
    _, group = np.unique(minimiser, return_inverse=True)
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
    # Ranges of words of each distinct string: from range_at[i] to range_at[i + 1].
    ranges: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        own = order[a:b].tolist()
        if len(own) == 1 and uses[own[0]] == 1:
            continue
        strings = [distinct[i].as_py() for i in own]
        flags = repeated_windows(strings, window) if len(own) > 1 else [None]
        for i, s, flag in zip(own, strings, flags, strict=True):
            if uses[i] > 1:
                ranges[i] = [(0, s.count(b" ") + 1)]
            elif flag.any():
                on = np.flatnonzero(np.diff(flag.astype(np.int8), prepend=0, append=0))
                ranges[i] = [(int(x), int(y) + window - 1) for x, y in zip(on[::2], on[1::2], strict=True)]
    sizes = np.zeros(len(distinct) + 1, np.int64)
    for i, r in ranges.items():
        sizes[i] = len(r)
    of_place = np.repeat(number, entry["uses"])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    bounds = np.array([x for i in sorted(ranges) for x in ranges[i]], np.int64).reshape(-1, 2)
    each = sizes[of_place]
    row = np.repeat(np.arange(len(place)), each)
    took = np.repeat(begin[of_place] - (np.cumsum(each) - each), each) + np.arange(len(row))
    start = place["start"][row].astype(np.int64)
    return pa.table({
        "key": pa.array(place["key"][row]),
        "hash": pa.array(place["text"][row]),
        "a": pa.array((start + bounds[took, 0]).astype(np.int32)),
        "b": pa.array((start + bounds[took, 1]).astype(np.int32)),
    })


def frequent_grams(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The sorted hashes of frequent grams (at most 2 / SHARE), and the bytes of all texts of docs(text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in steps(batches, limit=STEP):
            w = words(batch.column("text"), BLANK_WORDS)
            place, distinct = pd.factorize(grams(w.hashes()[w.codes], GRAM))
            times = np.bincount(place, minlength=len(distinct))
            often = np.flatnonzero(times > SHARE / 2 * len(place))
            size = pa.array([batch.column("text").nbytes] + [0] * len(often))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.zeros(1, np.int64), distinct[often].view(np.int64))), pa.array(np.append(len(place), times[often])), pa.array([True] + [False] * len(often)), size], names=["gram", "n", "whole", "size"])

    found = docs.select("text").mapInArrow(count, "gram long, n long, whole boolean, size long").groupBy("whole", "gram").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    found = written(found, "grams")
    total = found.filter("whole").first()
    least = max(LEAST, SHARE / 2 * (total["n"] if total else 0))
    often = found.filter(~F.col("whole") & (F.col("n") > least)).select("gram").collect()
    dropped(found)
    return np.sort(np.array([r["gram"] for r in often], np.int64).view(np.uint64)), total["size"] if total else 0


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, hash, ranges: the repeated word ranges of each document that has any."""
    frequent, size = frequent_grams(docs)
    buckets = max(64, 4 * partitions(docs.sparkSession), size // BUCKET_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in steps(batches):
            rows = list(packed(batch, buckets, window, frequent))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "strings", "entries", "places"])

    def count(blocks: pa.Table) -> pa.Table:
        lean()
        return counted(blocks, window)

    keyed = docs.select(row_key().alias("key"), F.hash("text").alias("hash"), "text")
    blocks = keyed.mapInArrow(send, "bucket int, strings binary, entries binary, places binary")
    found = blocks.groupBy("bucket").applyInArrow(count, "key long, hash int, a int, b int")
    return found.groupBy("key", "hash").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def row_key() -> Column:
    return F.coalesce(F.expr("try_cast(doc_id as long)"), F.xxhash64("doc_id", "text"))


def deduplicated(docs: DataFrame, window: int = WINDOW, whole: bool = False) -> DataFrame:
    """docs with text (the kept words joined by one blank), n_words and n_removed; other columns stay.

    whole: texts that lose no word stay as they are, white space and all.
    """
    docs = docs.drop("n_words", "n_removed")
    key, hash_, key2, hash2, ranges, first, stop = unused(docs, "_key", "_hash", "_of", "_its", "_ranges", "_a", "_b")
    found = repeated_ranges(docs.select("doc_id", "text"), window).toDF(key2, hash2, ranges)
    names = [f.name for f in docs.schema.fields]
    rows = docs.withColumns({key: row_key(), hash_: F.hash("text")})
    rows = rows.join(found, (F.col(key) == F.col(key2)) & (F.col(hash_) == F.col(hash2)), "left").select(*names, F.col(ranges)["a"].alias(first), F.col(ranges)["b"].alias(stop))
    schema = T.StructType([*(T.StructField(f.name, T.StringType()) if f.name == "text" else f for f in docs.schema.fields), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in steps(batches, limit=STEP):
            w = words(batch.column("text"), BLANK_WORDS)
            hit = np.zeros(len(w.codes) + 1, np.int32)
            starts, stops = pc.fill_null(batch.column(first), []), pc.fill_null(batch.column(stop), [])
            shift = np.repeat(w.offsets[:-1], pc.list_value_length(starts).to_numpy(zero_copy_only=False))
            np.add.at(hit, starts.flatten().to_numpy(zero_copy_only=False) + shift, 1)
            np.add.at(hit, stops.flatten().to_numpy(zero_copy_only=False) + shift, -1)
            keep = np.cumsum(hit[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(keep)])[w.offsets]
            text = joined(kept, w.vocabulary.take(pa.array(w.codes[keep]))).cast(pa.string())
            if whole:
                text = pc.if_else(pa.array(np.diff(kept) == w.counts), batch.column("text"), text)
            columns = {n: batch.column(n) for n in names} | {"text": text, "n_words": pa.array(w.counts), "n_removed": pa.array(w.counts - np.diff(kept))}
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(cut, schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS p,
    unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS g
  FROM d WHERE len(w) >= {WINDOW}),
dup AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS q FROM win WHERE g IN (SELECT g FROM dup)),
pos AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS t, count(*) AS n FROM pos ANTI JOIN hit USING (doc_id, q) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
