"""Audio and score files at the Python boundary: WAV in, samples' silences, MIDI and MusicXML out; models are injected."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folded
from ..schemas import FRAMES, TOKENS


def _chunks(data: bytes) -> dict[bytes, bytes]:
    out, at = {}, 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        out.setdefault(data[at : at + 4], data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return out


def wav_format(fmt: bytes) -> tuple[int, int, int, int]:
    """Kind, channels, rate and bits of a `fmt ` chunk."""
    kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", fmt[:16])
    if kind == 0xFFFE:  # extensible: the kind stands in its extension
        kind = int.from_bytes(fmt[24:26], "little")
    return kind, channels, rate, bits


def mono(raw: bytes, kind: int, channels: int, bits: int) -> np.ndarray:
    """Samples in [-1, 1], the mean of the channels."""
    if kind == 3:
        x = np.frombuffer(raw, {32: "<f4", 64: "<f8"}[bits])
    elif bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8)[: len(raw) // 3 * 3].reshape(-1, 3)
        x = wide.view("<i4").reshape(-1) / 2**31
    else:
        x = np.frombuffer(raw, {16: "<i2", 32: "<i4"}[bits]) / 2.0 ** (bits - 1)
    x = x.astype(np.float32)
    return x.reshape(-1, channels).mean(axis=1) if channels > 1 else x


def samples(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and their rate of a WAV file: integers of 8, 16, 24 or 32 bits, floats of 32 or 64."""
    parts = _chunks(data)
    kind, channels, rate, bits = wav_format(parts[b"fmt "])
    return mono(parts[b"data"], kind, channels, bits), rate


def chroma(x: np.ndarray, rate: int, seconds: float = 60.0, size: int = 8192) -> np.ndarray:
    """Shares of the 12 pitch classes in the first seconds: magnitudes of short spectra, each bin at its nearest note from C1 to B7."""
    x = x[: int(seconds * rate)]
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    hz = np.fft.rfftfreq(size, 1 / rate)
    midi = np.rint(12 * np.log2(np.maximum(hz, 1e-9) / 440) + 69).astype(int)
    use = (midi >= 24) & (midi <= 107)
    total, window = np.zeros(12), np.hanning(size)
    for at in range(0, len(x) - size + 1, size // 2):
        power = np.abs(np.fft.rfft(x[at : at + size] * window))
        total += np.bincount(midi[use] % 12, weights=power[use], minlength=12)
    return total / total.sum() if total.sum() > 0 else total


def tempo(x: np.ndarray, rate: int, size: int = 1024, hop: int = 256) -> float:
    """Beats a minute: the lag at which the onset strength is most like itself, lags near half a second preferred."""
    if len(x) < 8 * size:
        return 0.0
    spectra = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * np.hanning(size), axis=1))
    onset = np.maximum(np.diff(np.log1p(100 * spectra), axis=0), 0).sum(axis=1)
    onset = onset - onset.mean()
    n = 1 << (2 * len(onset) - 1).bit_length()
    auto = np.fft.irfft(np.abs(np.fft.rfft(onset, n)) ** 2)[: len(onset)]
    lag = np.arange(1, len(onset))
    bpm = 60 * rate / (hop * lag)
    weight = np.exp(-0.5 * np.log2(bpm / 120) ** 2)
    fits = (bpm >= 30) & (bpm <= 300)
    if not fits.any() or auto[0] <= 0:
        return 0.0
    best = int(lag[fits][np.argmax((auto[1:] * weight)[fits])])
    a, b, c = auto[best - 1], auto[best], auto[min(best + 1, len(auto) - 1)]
    shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c < 0 else 0.0
    return float(60 * rate / (hop * (best + shift)))


def muted(x: np.ndarray, rate: int, spans: list[tuple[float, float]]) -> np.ndarray:
    """The samples with nothing sung in the spans."""
    x = x.copy()
    for a, b in spans:
        x[int(a * rate) : int(b * rate)] = 0
    return x


def wav_bytes(x: np.ndarray, rate: int) -> bytes:
    """A mono WAV file of 16 bits."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def quiet_spans(x: np.ndarray, rate: int, least_ms: int = 50, level_db: float = -50.0) -> list[tuple[float, float]]:
    """Spans of at least least_ms in which each window of that length has a root mean square below the level; windows start each millisecond."""
    step = max(1, rate // 1000)
    size = least_ms * step
    if len(x) < size:
        return []
    power = np.concatenate([[0.0], np.cumsum(x.astype(np.float64) ** 2)])
    starts = np.arange(0, len(x) - size + 1, step)
    quiet = np.sqrt((power[starts + size] - power[starts]) / size) <= 10 ** (level_db / 20)
    edge = np.flatnonzero(np.diff(quiet.astype(np.int8), prepend=0, append=0))
    return [(a / 1000, (b - 1 + least_ms) / 1000) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """song_id, data of WAV files."""
    return spark.read.format("binaryFile").load(path).selectExpr("path as song_id", "content as data")


def silences(songs: DataFrame, least_ms: int = 50, level_db: float = -50.0) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, i, a, b) for s, data in zip(batch.song_id, batch.data, strict=True) for i, (a, b) in enumerate(quiet_spans(*samples(bytes(data)), least_ms, level_db))]
            yield pd.DataFrame(rows, columns=["song_id", "sil_idx", "start", "end"])

    return songs.select("song_id", "data").mapInPandas(run, "song_id string, sil_idx int, start double, end double")


def chroma_weights(songs: DataFrame) -> DataFrame:
    """song_id, pc, weight of songs(song_id, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for song, data in zip(batch.song_id, batch.data, strict=True):
                yield pd.DataFrame({"song_id": song, "pc": np.arange(12, dtype=np.int32), "weight": chroma(*samples(bytes(data)))})

    return songs.select("song_id", "data").mapInPandas(run, "song_id string, pc int, weight double")


def tempos(songs: DataFrame) -> DataFrame:
    """song_id, bpm of songs(song_id, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"song_id": batch.song_id, "bpm": [tempo(*samples(bytes(d))) for d in batch.data]})

    return songs.select("song_id", "data").mapInPandas(run, "song_id string, bpm double")


def chunk_files(songs: DataFrame, manifest: DataFrame) -> DataFrame:
    """song_id, file, data: the WAV of each chunk of manifest(song_id, file, first_frame, last_frame), mono."""
    both = songs.select("song_id", "data").join(manifest.groupBy("song_id").agg(F.collect_list(F.struct("file", "first_frame", "last_frame")).alias("chunks")), "song_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for song, data, chunks in zip(batch.song_id, batch.data, batch.chunks, strict=True):
                x, rate = samples(bytes(data))
                yield pd.DataFrame([(song, c["file"], wav_bytes(x[c["first_frame"] : c["last_frame"]], rate)) for c in chunks], columns=["song_id", "file", "data"])

    return both.mapInPandas(run, "song_id string, file string, data binary")


def muted_files(songs: DataFrame, spans: DataFrame) -> DataFrame:
    """song_id, data: mono WAV files of songs(song_id, data), muted in their spans(song_id, start, end)."""
    both = songs.select("song_id", "data").join(spans.groupBy("song_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "song_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for song, data, own in zip(batch.song_id, batch.data, batch.spans, strict=True):
                x, rate = samples(bytes(data))
                rows.append((song, wav_bytes(muted(x, rate, [(s["start"], s["end"]) for s in ([] if own is None else own)]), rate)))
            yield pd.DataFrame(rows, columns=["song_id", "data"])

    return both.mapInPandas(run, "song_id string, data binary")


def pitch_frames(songs: DataFrame, model: Callable[[], Callable[[np.ndarray, int], tuple]]) -> DataFrame:
    """Frames by an injected model: model() is called once a worker and gives f(samples, rate) -> times, frequencies, confidences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = model()
        for batch in batches:
            for song, data in zip(batch.song_id, batch.data, strict=True):
                t, f, c = detect(*samples(bytes(data)))
                yield pd.DataFrame({"song_id": song, "frame_idx": np.arange(len(t), dtype=np.int32), "t": t, "freq": f, "conf": c})

    return songs.select("song_id", "data").mapInPandas(run, FRAMES)


def transcribed(songs: DataFrame, model: Callable[[], Callable[[np.ndarray, int], list[tuple]]]) -> DataFrame:
    """Tokens by an injected model: f(samples, rate) -> (word, start, end, confidence) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hear = model()
        for batch in batches:
            rows = [(s, i, f"{w} ", a, b, c, False, True) for s, data in zip(batch.song_id, batch.data, strict=True) for i, (w, a, b, c) in enumerate(hear(*samples(bytes(data))))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in TOKENS.split(", ")])

    return songs.select("song_id", "data").mapInPandas(run, TOKENS)


def _length(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(reversed(out))


def midi_file(notes: list[tuple[int, float, float, str]], bpm: float, ticks: int = 480) -> bytes:
    """One "Vocals" track of notes (midi, start, end, lyric) with velocity 100."""
    at = lambda s: round(s * bpm / 60 * ticks)
    events = [(0, 0, b"\xff\x03\x06Vocals"), (0, 0, b"\xff\x51\x03" + round(60_000_000 / bpm).to_bytes(3, "big"))]
    for pitch, start, end, lyric in notes:
        text = folded(lyric).encode("ascii")
        events += [(at(start), 2, b"\xff\x05" + _length(len(text)) + text), (at(start), 3, bytes([0x90, pitch, 100])), (at(end), 1, bytes([0x80, pitch, 0]))]
    body, now = b"", 0
    for tick, _, data in sorted(events, key=lambda e: e[:2]):
        body, now = body + _length(tick - now) + data, tick
    body += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, ticks) + b"MTrk" + struct.pack(">I", len(body)) + body


def midi_files(notes: DataFrame, bpm: float) -> DataFrame:
    """song_id, data: a MIDI file for each song of notes(song_id, midi, start, end, word)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["start", "midi"])[["midi", "start", "end", "word"]].itertuples(index=False, name=None)
        return pd.DataFrame({"song_id": [str(group.song_id.iloc[0])], "data": [midi_file(list(rows), bpm)]})

    return notes.groupBy("song_id").applyInPandas(run, "song_id string, data binary")
