"""Shared pieces of the corpus operators: shared storage, batch slicing, exact tokenising and hashing."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step looks at; a larger document is a step of its own.
STEP_BYTES = 8 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Parameters of the C library's mallopt.
_MMAP_THRESHOLD, _TRIM_THRESHOLD = -3, -1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Unset, it is a temporary one, which only a master on this machine allows."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="notewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: df as a table in the shared folder, which outlives any executor. Its plan's shuffle files go when it is written."""
    spark = df.sparkSession
    path, was = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove a table made by written()."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for place in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(conf).delete(path, True)


def lean() -> None:
    """Have a worker give freed memory back to the system: large blocks are mapped one by one, Arrow's too."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(_MMAP_THRESHOLD, 8 << 20)
        libc.mallopt(_TRIM_THRESHOLD, 16 << 20)
    except (OSError, AttributeError):  # another C library: blocks stay in its pool
        pass


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no column of that name."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def root_buckets(rows: int) -> int:
    """Buckets for a two-level rank: as many buckets as rows in each."""
    return max(1, math.isqrt(max(rows, 1)))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one step holds at most limit bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _table(word_bytes: np.ndarray, lower: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[~word_bytes] = 32
    if lower:
        table[65:91] += 32 * word_bytes[65:91].astype(np.uint8)
    return table


_BYTES = np.arange(256)
_BLANK = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_OTHER = (_BYTES <= 0x2F) | ((_BYTES >= 0x3A) & (_BYTES <= 0x40)) | ((_BYTES >= 0x5B) & (_BYTES <= 0x60)) | ((_BYTES >= 0x7B) & (_BYTES <= 0x7F))
#: Bytes that end a word become a blank, the others stay or are lower-cased; all of them are ASCII, so UTF-8 stays whole.
BLANK_WORDS, BLANK_WORDS_LOWER, ALNUM_WORDS_LOWER = _table(~_BLANK, False), _table(~_BLANK, True), _table(~_OTHER, True)


class Words:
    """The words of a step: codes[offsets[i]:offsets[i + 1]] are those of row i, as places in vocabulary."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, vocabulary: pa.Array):
        self.codes, self.offsets, self.vocabulary = codes, offsets, vocabulary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the vocabulary, the same in every process."""
        if not len(self.vocabulary):
            return np.zeros(0, np.uint64)
        return pd.util.hash_array(self.vocabulary.to_numpy(zero_copy_only=False), categorize=False)


def mapped(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """The texts with each byte replaced; null becomes empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.concat_arrays([texts.slice(0, len(texts))])
    _, offsets, data = texts.buffers()
    first = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[first[0] : first[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(first - first[0])), pa.py_buffer(table[raw]))


def words(texts: pa.Array, table: np.ndarray) -> Words:
    """Split each text at what the table maps to a blank, without empty words."""
    split = pc.split_pattern(mapped(texts, table), " ")
    flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return Words(coded.indices.to_numpy().astype(np.int64), before[offsets - offsets[0]], coded.dictionary)


def joined(offsets: np.ndarray, flat: pa.Array) -> pa.Array:
    """For each row the strings flat[offsets[i]:offsets[i + 1]], joined by one blank."""
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat) if flat.type == pa.string() else pa.LargeListArray.from_arrays(pa.array(offsets), flat)
    return pc.binary_join(lists, pa.scalar(" ", flat.type))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes, across row borders too; empty when there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(hashes) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
    return mixed(out)


