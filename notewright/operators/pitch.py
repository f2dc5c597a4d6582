"""A pitch tracker of its own: candidates from the difference function, frame by frame, and the best path through them along a song.

Frames lie HOP seconds apart whatever the blocks (sources.wav_blocks.BLOCKS). How unlike a stretch of samples is to itself a lag later is
worked out by one transform for all lags; a lag at which that is low against the lags before it is a period. What a frame alone cannot tell, an octave
above all, the path does: it pays for unlikeness and for leaps. Candidates are rows made by many tasks for a song, the path is
one task's work on some numbers a frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..schemas import FRAMES
from .spectra import _blocks

HOP, LOW, HIGH = 0.016, 46.875, 2093.75
#: Candidates of a frame; what a lag longer by an octave costs, and a leap of one; what it costs to begin or end singing, and not to sing.
CANDIDATES, LONGER, LEAP, TURN, UNSUNG = 6, 0.04, 0.6, 0.3, 0.6


def widths(rate: int, low: float = LOW) -> tuple[int, int]:
    """The longest lag in samples, and how many samples are compared."""
    longest = int(np.ceil(rate / low)) + 2
    return longest, 2 * longest


def unlikeness(x: np.ndarray, longest: int, width: int) -> np.ndarray:
    """For each row of width + longest samples: the squared difference at each lag, by the mean of those at the lags before it; 1 in silence."""
    size = 1 << (x.shape[1] + width).bit_length()
    own = np.fft.rfft(x[:, :width], size, axis=1)
    both = np.fft.irfft(np.conj(own) * np.fft.rfft(x, size, axis=1), size, axis=1)[:, : longest + 1]
    power = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x**2, axis=1)], axis=1)
    lag = np.arange(longest + 1)
    d = np.maximum(power[:, width : width + 1] + power[:, lag + width] - power[:, lag] - 2 * both, 0)
    d[:, 0] = 0
    total = np.cumsum(d, axis=1)
    quiet = total <= 1e-9 * (lag + 1) * width
    return np.where(quiet | (lag == 0), 1.0, d * np.maximum(lag, 1) / np.maximum(total, 1e-30))


def candidates_of(u: np.ndarray, rate: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and unlikeness of the best CANDIDATES valleys of each row, placed between lags by a parabola; NaN where there are fewer.

    A period's multiples are as good as itself, so each octave of a longer lag adds LONGER.
    """
    first = max(2, int(rate / high))
    mid, left, right = u[:, first:-1], u[:, first - 1 : -2], u[:, first + 1 :]
    bend = left - 2 * mid + right
    shift = np.where(bend > 0, 0.5 * (left - right) / np.where(bend > 0, bend, 1), 0)
    lag = np.arange(first, first + mid.shape[1]) + shift
    cost = np.clip(mid - 0.25 * (left - right) * shift, 0, None) + LONGER * np.log2(np.maximum(lag, 1) / first)
    valley = (mid < left) & (mid <= right) & (rate / lag >= low) & (rate / lag <= high * 1.03)
    value = np.where(valley, cost, np.inf)
    rows, at = np.arange(len(u))[:, None], np.argsort(value, axis=1, kind="stable")[:, :CANDIDATES]
    none = ~np.isfinite(value[rows, at])
    return np.where(none, np.nan, rate / lag[rows, at]), np.where(none, np.nan, cost[rows, at])


def candidates(blocks: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """song_id, frame_idx, t, hz, cost (lists) of the frames whose time lies in a block. Blocks need half of three longest lags (widths) on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            longest, width = widths(b.rate, low)
            step, whole = HOP * b.rate, longest + width
            frame = np.arange(int(np.ceil(b.first / step)), int(np.ceil((b.first + b.own) / step)))
            for k in range(0, len(frame), 256):
                at = frame[k : k + 256]
                middle = np.rint(at * step).astype(int)
                hz, cost = candidates_of(unlikeness(b.slices(middle - whole // 2, whole), longest, width), b.rate, low, high)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * CANDIDATES), pa.array(v.ravel())) for v in (hz, cost)]
                yield pa.RecordBatch.from_arrays([pa.array([b.song] * len(at)), pa.array(at.astype(np.int32)), pa.array(at * HOP), *lists], names=["song_id", "frame_idx", "t", "hz", "cost"])

    return blocks.mapInArrow(run, "song_id string, frame_idx int, t double, hz array<double>, cost array<double>")


def best_track(hz: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequency and confidence of each frame on the path of the least cost. A frame that is not sung has its likeliest frequency, and little confidence."""
    frames, n = hz.shape
    tone = np.log2(np.where(np.isnan(hz), 1.0, hz))
    own = np.concatenate([np.where(np.isnan(hz), np.inf, cost), np.full((frames, 1), UNSUNG)], axis=1)
    total, back = own[0].copy(), np.zeros((frames, n + 1), np.int64)
    for t in range(1, frames):
        move = np.zeros((n + 1, n + 1))
        move[:n, :n] = LEAP * np.abs(tone[t - 1][:, None] - tone[t][None])
        move[:n, n] = move[n, :n] = TURN
        way = total[:, None] + move
        back[t] = way.argmin(axis=0)
        total = way[back[t], np.arange(n + 1)] + own[t]
    path = np.zeros(frames, np.int64)
    path[-1] = total.argmin()
    for t in range(frames - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    sung = path < n
    rows, pick = np.arange(frames), np.where(sung, path, own[:, :n].argmin(axis=1))
    freq, worth = hz[rows, pick], np.clip(1 - np.nan_to_num(cost[rows, pick], nan=1.0), 0, 1)
    return np.nan_to_num(freq, nan=0.0), np.where(sung, worth, np.minimum(worth, 0.3))


def tracked(blocks: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Frames(song_id, frame_idx, t, freq, conf) of blocks; freq is 0 where a frame has no candidate at all. See sources.media.pitch_frames for an injected model instead."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("frame_idx")
        hz, cost = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in group.column(x).chunks]).reshape(-1, CANDIDATES) for x in ("hz", "cost"))
        freq, conf = best_track(hz, cost)
        return pa.table([group.column("song_id"), group.column("frame_idx"), group.column("t"), pa.array(freq), pa.array(conf)], names=[x.split()[0] for x in FRAMES.split(", ")])

    return candidates(blocks, low, high).groupBy("song_id").applyInArrow(run, FRAMES)
