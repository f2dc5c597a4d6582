"""WAV files as rows of some thousand samples each: a Spark data source that reads one large file in many tasks.

    spark.dataSource.register(WavBlocks)
    spark.read.format("wav_blocks").option("block", 65536).option("after", 4096).load("/songs")

A partition is a byte range of one file. It reads the file's header itself, then the blocks that begin in its range, so the
driver only lists names and sizes, and blocks lie at the same samples however the file is split. Files are opened through
pyarrow's file systems (a local path, or a URI such as s3:// or hdfs://). What is shorter than its header says ends where it ends.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .media import mono, samples, wav_format

#: song_id; first: the block's first sample; total: samples of the song; lead: how many of `samples` lie before the block, own: how many are its own.
BLOCKS = "song_id string, first long, total long, rate int, lead int, own int, samples array<float>"
BLOCK, SPLIT_BYTES = 1 << 16, 32 << 20


@dataclass
class Span(InputPartition):
    path: str
    start: int
    stop: int


def header(f: pa.NativeFile, size: int) -> tuple[tuple[int, int, int, int], int, int] | None:
    """Format, place and size of the samples; None for what is no WAV file. RIFF and RF64, whose sizes may pass 4 GB."""
    head = f.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        return None
    form, wide, at = None, 0, 12
    while at + 8 <= size:
        f.seek(at)
        name, n = struct.unpack("<4sI", f.read(8))
        if name == b"ds64":
            wide = struct.unpack("<QQ", f.read(16))[1]
        elif name == b"fmt ":
            form = wav_format(f.read(n))
        elif name == b"data":
            # Without a size the samples last to the file's end; so they do in one that was cut off.
            n = wide if n == 0xFFFFFFFF and wide else n
            return (form, at + 8, min(n or size, size - at - 8)) if form else None
        at += 8 + n + n % 2
    return None


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float32()))
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCKS.split(", ")])


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p.strip() for p in options.get("path", "").split(",") if p.strip()]
        self.block, self.before, self.after = (int(options.get(k, d)) for k, d in (("block", BLOCK), ("before", 0), ("after", 0)))
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        if not self.paths or min(self.block, self.split) < 1 or min(self.before, self.after) < 0:
            raise ValueError("wav_blocks needs a path, a positive block and splitBytes, and no negative before or after")

    def partitions(self) -> list[Span]:
        found = []
        for path in self.paths:
            system, own = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            info = system.get_file_info(own)
            infos = system.get_file_info(fs.FileSelector(own, recursive=True)) if info.type == fs.FileType.Directory else [info]
            root = path.split("://")[0] + "://" if "://" in path and not isinstance(system, fs.LocalFileSystem) else ""
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            for x in sorted(infos, key=lambda i: i.path):
                if x.type == fs.FileType.File and (x.path == own or x.path.lower().endswith(".wav")):
                    found += [Span(root + x.path, a, min(x.size, a + self.split)) for a in range(0, max(x.size, 1), self.split)]
        return found

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        path = partition.path
        system, own = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with system.open_input_file(own) as f:
            found = header(f, f.size())
            if found is None:
                return
            (kind, channels, rate, bits), at, size = found
            wide = channels * bits // 8
            total = size // wide
            number = max(0, -(-(partition.start - at) // (self.block * wide)))
            while number * self.block < total and at + number * self.block * wide < partition.stop:
                first = number * self.block
                low, high = max(0, first - self.before), min(total, first + self.block + self.after)
                f.seek(at + low * wide)
                x = mono(f.read((high - low) * wide), kind, channels, bits)
                yield _rows([(path, first, total, rate, first - low, min(self.block, total - first), x)])
                number += 1


class WavBlocks(DataSource):
    """Options: path (files or folders, comma between), block (samples of a row), before and after (samples of the neighbours that a row also has), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def blocks_of(songs: DataFrame, block: int = BLOCK, before: int = 0, after: int = 0) -> DataFrame:
    """The same rows of songs(song_id, data) that are in a table: each WAV file is read by the task that has it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for song, data in zip(batch.column("song_id").to_pylist(), batch.column("data"), strict=True):
                x, rate = samples(data.as_buffer().to_pybytes())
                for first in range(0, len(x), block):
                    low = max(0, first - before)
                    yield _rows([(song, first, len(x), rate, first - low, min(block, len(x) - first), x[low : first + block + after])])

    return songs.filter("data is not null").selectExpr("cast(song_id as string) as song_id", "data").mapInArrow(run, BLOCKS)


def samples_of(blocks: DataFrame) -> np.ndarray:
    """All samples of one song's blocks, on the driver: for tests and short songs."""
    rows = sorted(blocks.collect(), key=lambda r: r["first"])
    return np.concatenate([np.array(r["samples"][r["lead"] : r["lead"] + r["own"]], np.float32) for r in rows]) if rows else np.zeros(0, np.float32)
