"""Work over blocks of samples: spectrograms, constant-Q chroma, denoising, silences, muting. One song is many rows, so many tasks.

Each row of blocks (sources.wav_blocks.BLOCKS) works on the windows that begin, are centred, or overlap in its own samples, and needs as many of its
neighbours' samples as these reach over; windows lie at multiples of the hop from the song's first sample, whatever the
blocks. What a whole song decides (a mean, a noise floor) is a sum or a minimum over its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SIZE, HOP = 256, 128
#: Frequency of C1, octaves, and steps of an octave of the constant-Q transform.
LOW, OCTAVES, STEPS = 440.0 * 2 ** (-45 / 12), 7, 36


class _Block:
    def __init__(self, batch: pa.RecordBatch, i: int):
        row = {c: batch.column(c)[i] for c in ("song_id", "first", "total", "rate", "lead", "own")}
        self.song, self.first, self.total, self.rate, self.lead, self.own = (x.as_py() for x in row.values())
        self.x = batch.column("samples")[i].values.to_numpy(zero_copy_only=False).astype(np.float64)

    def slices(self, starts: np.ndarray, size: int) -> np.ndarray:
        """The song's samples from each start on, zeros outside the song; an error if the row lacks some of them."""
        low, high = self.first - self.lead, self.first - self.lead + len(self.x)
        a, b = int(starts.min()), int(starts.max()) + size
        if max(a, 0) < low or min(b, self.total) > high:
            raise ValueError(f"a row has samples {low} to {high} of {self.song}, {max(a, 0)} to {min(b, self.total)} are needed: read blocks with more before or after")
        x = np.pad(self.x, (max(0, low - a), max(0, b - high)))[max(0, a - low) :]
        return np.lib.stride_tricks.sliding_window_view(x, size)[starts - a]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Block(batch, i)


def _window(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))


def power_density(x: np.ndarray, rate: int) -> np.ndarray:
    """Power density of each row of samples under a raised-cosine window, one-sided."""
    w = _window(x.shape[1])
    p = np.abs(np.fft.rfft(x * w, axis=1)) ** 2 / (rate * (w**2).sum())
    p[:, 1 : -1 if x.shape[1] % 2 == 0 else None] *= 2
    return p


def spectra(blocks: DataFrame, size: int = SIZE, hop: int = HOP) -> DataFrame:
    """song_id, column, t (of the window's middle), power (density by bin): the windows that fit into the song. Blocks need size - 1 samples after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            column = np.arange(-(-b.first // hop), (min(b.first + b.own - 1, b.total - size) // hop) + 1)
            if len(column):
                p = power_density(b.slices(column * hop, size), b.rate)
                bins = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([b.song] * len(p)), pa.array(column), pa.array((column * hop + size / 2) / b.rate), bins], names=["song_id", "column", "t", "power"])

    return blocks.mapInArrow(run, "song_id string, column long, t double, power array<double>")


def spectrogram(blocks: DataFrame, size: int = SIZE, hop: int = HOP) -> DataFrame:
    """song_id, column, bin, db: power density in decibels; null where there is no power."""
    rows = spectra(blocks, size, hop).select("song_id", "column", F.posexplode("power").alias("bin", "_p"))
    return rows.select("song_id", "column", "bin", F.when(F.col("_p") > 0, 10 * F.log10("_p")).alias("db"))


@cache
def kernels(rate: int) -> tuple[int, list[tuple[int, np.ndarray, int]]]:
    """Length of the transform, and of each constant-Q bin below half the rate: its first frequency, its spectrum's values from there on, its pitch class.

    A bin's filter is a windowed tone of as many periods as tell it from its neighbour, all centred; of its spectrum only what
    matters is kept, a run of frequencies around the bin's own.
    """
    q = 1 / (2 ** (1 / STEPS) - 1)
    size = 1 << math.ceil(math.log2(q * rate / LOW))
    out = []
    for k in range(OCTAVES * STEPS):
        hz = LOW * 2 ** (k / STEPS)
        if hz * (1 + 1 / q) >= rate / 2:
            break
        n = int(q * rate / hz)
        tone = np.zeros(size, complex)
        tone[(size - n) // 2 : (size - n) // 2 + n] = _window(n) / (n / 2) * np.exp(2j * np.pi * hz / rate * (np.arange(n) - n / 2))
        spectrum = np.fft.fft(tone)[: size // 2 + 1]
        use = np.flatnonzero(np.abs(spectrum) > 0.005 * np.abs(spectrum).max())
        out.append((int(use[0]), np.conj(spectrum[use[0] : use[-1] + 1]) / size, (k + 1) // 3 % 12))
    return size, out


def reach(rate: int) -> int:
    """Samples that a window of the constant-Q transform reaches over on each side."""
    return kernels(rate)[0] // 2


def chroma_frames(x: np.ndarray, rate: int) -> np.ndarray:
    """Weights of the twelve pitch classes of each row of samples, of each row the greatest 1; none in silence."""
    _, bins = kernels(rate)
    spectrum, out = np.fft.rfft(x, axis=1), np.zeros((len(x), 12))
    for first, own, pc in bins:
        out[:, pc] += np.abs(spectrum[:, first : first + len(own)] @ own)
    top = out.max(axis=1, keepdims=True)
    return np.divide(out, top, out=np.zeros_like(out), where=top > 1e-9)


def chroma_weights(blocks: DataFrame, seconds: float = 60.0, hop: int = 4096) -> DataFrame:
    """song_id, pc, weight: shares of the pitch classes C1 to B7 in the first seconds, each window counting the same. Blocks need reach(rate) samples on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            size, stop = 2 * reach(b.rate), min(b.first + b.own, int(seconds * b.rate))
            centres, total = np.arange(-(-b.first // hop) * hop, stop, hop), np.zeros(12)
            for k in range(0, len(centres), 32):
                total += chroma_frames(b.slices(centres[k : k + 32] - size // 2, size), b.rate).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([b.song] * 12), pa.array(np.arange(12, dtype=np.int32)), pa.array(total)], names=["song_id", "pc", "weight"])

    early = blocks.filter(F.col("first") < F.col("rate") * F.lit(seconds))
    sums = early.mapInArrow(run, "song_id string, pc int, weight double").groupBy("song_id", "pc").agg(F.sum("weight").alias("weight"))
    every = F.sum("weight").over(W.partitionBy("song_id"))
    return sums.select("song_id", "pc", F.when(every > 0, F.col("weight") / every).otherwise(0.0).alias("weight"))


def noise_floor(blocks: DataFrame, size: int, seconds: float = 1.0) -> DataFrame:
    """song_id, floor: by bin, the least mean power of any stretch of so many seconds (or all, if the song is shorter). Blocks need size - 1 samples after them."""
    powers = spectra(blocks, size, size // 2).withColumn("_stretch", F.floor(F.col("t") / seconds))
    each = powers.select("song_id", "_stretch", F.posexplode("power").alias("bin", "_p")).groupBy("song_id", "_stretch", "bin").agg(F.avg("_p").alias("_p"), F.count("*").alias("_n"))
    # A stretch at the end that is less than half full says little.
    full = F.col("_n") * 2 >= F.max("_n").over(W.partitionBy("song_id", "bin"))
    least = each.withColumn("_full", full).filter("_full").groupBy("song_id", "bin").agg(F.min("_p").alias("_p"))
    return least.groupBy("song_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "_p"))), lambda x: x["_p"]).alias("floor"))


def denoised(blocks: DataFrame, reduction_db: float = 12.0, size: int = 1024, over: float = 10.0) -> DataFrame:
    """blocks with their own samples only, noise turned down by reduction_db.

    Windows of size samples overlap by half and add up to one. In each, a frequency with power under `over` times the noise floor is
    noise and loses reduction_db; between that and twice as much the gain rises to one. Blocks need size samples on both sides.
    """
    hop, least = size // 2, 10 ** (-reduction_db / 20)
    half = np.sqrt(0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(size) + 0.5) / size))  # its square adds up to one with a half-window's shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b in enumerate(_blocks(iter([batch]))):
                floor = np.array(batch.column("floor")[i].as_py() or np.zeros(hop + 1))
                starts = np.arange((b.first - size) // hop + 1, (b.first + b.own - 1) // hop + 1) * hop
                x = b.slices(starts, size)
                ratio = power_density(x, b.rate) / np.maximum(floor * over, 1e-30)
                gain = least + (1 - least) * np.clip(ratio - 1, 0, 1)
                y = np.fft.irfft(np.fft.rfft(x * half, axis=1) * gain, size, axis=1) * half
                out = np.zeros((len(starts) + 1) * hop)
                for part in (0, 1):
                    out[part * hop : part * hop + len(starts) * hop] += y[:, part * hop : (part + 1) * hop].ravel()
                own = out[b.first - int(starts[0]) :][: b.own].astype(np.float32)
                rows = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own))
                names = ["song_id", "first", "total", "rate", "own"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in names), pa.array([0], pa.int32()), rows], names=[*names, "lead", "samples"]).select(["song_id", "first", "total", "rate", "lead", "own", "samples"])

    both = blocks.join(noise_floor(blocks, size), "song_id", "left")
    return both.mapInArrow(run, blocks.schema)


def silences(blocks: DataFrame, least_ms: int = 50, level_db: float = -50.0) -> DataFrame:
    """song_id, sil_idx, start, end: spans of at least least_ms in which each window of that length has a root mean square below the level; windows start each millisecond.

    Each block tells its runs of quiet windows; runs that meet at a border are one. Blocks need the samples of one window after them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            step = max(1, b.rate // 1000)
            size = least_ms * step
            first, stop = -(-b.first // step), min(-(-(b.first + b.own) // step), (b.total - size) // step + 1)
            if stop <= first:
                continue
            x = b.slices(np.array([first * step]), (stop - 1 - first) * step + size)[0]
            power = np.concatenate([[0.0], np.cumsum(x**2)])
            at = (np.arange(first, stop) - first) * step
            quiet = np.sqrt((power[at + size] - power[at]) / size) <= 10 ** (level_db / 20)
            edge = np.flatnonzero(np.diff(quiet.astype(np.int8), prepend=0, append=0)) + first
            yield pa.RecordBatch.from_arrays([pa.array([b.song] * (len(edge) // 2), pa.string()), pa.array(edge[::2].astype(np.int64)), pa.array(edge[1::2].astype(np.int64))], names=["song_id", "a", "b"])

    runs = blocks.mapInArrow(run, "song_id string, a long, b long")
    w = W.partitionBy("song_id").orderBy("a")
    runs = runs.withColumn("_new", F.coalesce(F.col("a") > F.lag("b").over(w), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    spans = runs.groupBy("song_id", "_run").agg((F.min("a") / 1000).alias("start"), ((F.max("b") - 1 + least_ms) / 1000).alias("end"))
    return spans.select("song_id", (F.row_number().over(W.partitionBy("song_id").orderBy("_run")) - 1).alias("sil_idx"), "start", "end")


def muted(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """blocks with their samples set to 0 within spans(song_id, start, end) of seconds; a span goes to the blocks that it touches."""
    size = F.col("_size")
    sizes = blocks.groupBy("song_id").agg(F.max("rate").alias("_rate"), F.max("own").alias("_size"), F.max(F.size("samples")).alias("_all"))
    own = spans.join(sizes, "song_id").withColumns({"_a": F.floor(F.col("start") * F.col("_rate")), "_b": F.floor(F.col("end") * F.col("_rate"))}).filter("_b > _a")
    low, high = F.floor((F.col("_a") - F.col("_all")) / size), F.ceil((F.col("_b") + F.col("_all")) / size)
    own = own.select("song_id", "_a", "_b", size, F.explode(F.sequence(F.greatest(low, F.lit(0).cast("long")), high)).alias("_k")).select("song_id", (F.col("_k") * size).alias("first"), F.struct("_a", "_b").alias("_s"))
    own = own.groupBy("song_id", "first").agg(F.collect_list("_s").alias("_spans"))
    start = F.col("first") - F.col("lead")
    quiet = lambda i: F.exists("_spans", lambda s: (start + i >= s["_a"]) & (start + i < s["_b"]))
    out = blocks.join(own, ["song_id", "first"], "left")
    silent = F.transform("samples", lambda v, i: F.when(quiet(i), F.lit(0.0).cast("float")).otherwise(v))
    return out.withColumn("samples", F.when(F.col("_spans").isNull(), F.col("samples")).otherwise(silent)).select(blocks.columns)
