"""Forced alignment: when each word of a known text is sung, from a speech model's emissions.

A segment's symbols are put on its frames in order by a max-plus recurrence over frames: before frame t either the same number of symbols
is done and the frame is blank, or one fewer and the frame is the next symbol. It is the one step of a song that cannot be cut
into tasks, so a segment (some seconds of a song) is a group; what is in a group is its frames times the symbols of its own text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK, BETWEEN = "-", "|"
ALIGNED = "song_id {song}, segment int, seq int, word string, start double, end double, score double"


def best_path(blank: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """First frame, frame after the last one and mean probability of each symbol; None if they do not fit on the frames.

    blank: log probability by frame; own: by frame and symbol of the text. The text fills all frames, blank ones before its first symbol
    aside: a symbol lasts until the next one. Of a stay and a step that are equally likely, the stay is taken.
    """
    frames, symbols = own.shape
    if not 0 < symbols <= frames:
        return None
    score = np.full(symbols + 1, -np.inf)
    score[0] = 0.0
    stepped = np.zeros((frames, symbols + 1), bool)
    for t in range(frames):
        stay, step = score + blank[t], np.full(symbols + 1, -np.inf)
        step[1:] = score[:-1] + own[t]
        stepped[t] = step > stay
        score = np.maximum(stay, step)
    t, j = frames - 1, symbols
    if score[-1] == -np.inf:
        return None
    first, last, total, n = np.zeros(symbols, np.int64), np.zeros(symbols, np.int64), np.zeros(symbols), np.zeros(symbols, np.int64)
    while j:
        last[j - 1] = last[j - 1] or t + 1
        first[j - 1] = t
        total[j - 1] += np.exp(own[t, j - 1] if stepped[t, j] else blank[t])
        n[j - 1] += 1
        j -= int(stepped[t, j])
        t -= 1
    return first, last, total / n


def _placed(words: list[str], symbols: dict[str, int], logs: np.ndarray, blank: str, between: str) -> list[tuple[float, float, float]]:
    """start and end (in frames) and score of each word; NaN where it has no symbol that the model knows."""
    order, owner = [], []
    for k, w in enumerate(words):
        own = [c for c in (w or "").lower() if c in symbols and c not in (blank, between)]
        if own and order and between in symbols:
            order.append(between)
            owner.append(-1)
        order += own
        owner += [k] * len(own)
    none = (np.nan, np.nan, np.nan)
    path = best_path(logs[:, symbols[blank]], logs[:, [symbols[c] for c in order]]) if order and blank in symbols else None
    if path is None:
        return [none] * len(words)
    first, last, score = path
    out, owner = [], np.array(owner)
    for k in range(len(words)):
        at = np.flatnonzero(owner == k)
        size = last[at] - first[at]
        out.append((float(first[at[0]]), float(last[at[-1]]), float((score[at] * size).sum() / size.sum())) if len(at) else none)
    return out


def aligned(words: DataFrame, emissions: DataFrame, seconds: float, blank: str = BLANK, between: str = BETWEEN) -> DataFrame:
    """words(song_id, segment, seq, word, offset) with start, end and score, from emissions(song_id, segment, frame, symbol, logp).

    offset: second at which the segment's frame 0 lies; seconds: length of a frame. A symbol that a frame does not list is impossible there. A word
    without a symbol that its segment's emissions know has null times, as have all words of a segment whose text does not
    fit; sequences.filled_times places them. Words without a segment's emissions keep null times, emissions without words give no rows.
    """
    song = words.schema["song_id"].dataType.simpleString()
    keys, columns = ["song_id", "segment"], [x.split()[0] for x in ALIGNED.split(", ")]

    def run(text: pd.DataFrame, frames: pd.DataFrame) -> pd.DataFrame:
        text = text.sort_values("seq")
        spans = [(np.nan, np.nan, np.nan)] * len(text)
        frames = frames.dropna(subset=["frame", "symbol", "logp"])
        if len(text) and len(frames):
            code, names = pd.factorize(frames.symbol)
            frame = frames.frame.to_numpy() - frames.frame.min()
            logs = np.full((int(frame.max()) + 1, len(names)), -np.inf)
            np.maximum.at(logs, (frame, code), frames.logp.to_numpy())
            base = text.offset.to_numpy() + seconds * float(frames.frame.min())
            spans = [(at + a * seconds, at + b * seconds, s) for at, (a, b, s) in zip(base, _placed(text.word.tolist(), {c: i for i, c in enumerate(names)}, logs, blank, between), strict=True)]
        start, end, score = zip(*spans, strict=True) if spans else ((), (), ())
        return pd.DataFrame({"song_id": text.song_id, "segment": text.segment, "seq": text.seq, "word": text.word, "start": start, "end": end, "score": score})[columns]

    left = words.select(*keys, "seq", "word", "offset").groupBy(*keys)
    out = left.cogroup(emissions.select(*keys, "frame", "symbol", "logp").groupBy(*keys)).applyInPandas(run, ALIGNED.format(song=song))
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("song_id", "segment", "seq", "word", known("start"), known("end"), known("score"))
