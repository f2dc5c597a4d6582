"""Windows and sessions over streams of frames(song_id, ts, freq, conf) with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E


def grid_notes(frames: DataFrame, grid: str, late: str) -> DataFrame:
    """How often each note is heard in each grid window."""
    midi = E.hz_to_midi(F.col("freq")).alias("midi")
    return frames.withWatermark("ts", late).groupBy("song_id", F.window("ts", grid), midi).agg(F.count("*").alias("n"), F.avg("conf").alias("conf"))


def sung_spans(frames: DataFrame, gap: str, late: str) -> DataFrame:
    """Spans of frames that follow each other within the gap: what lies between them is silence."""
    return frames.withWatermark("ts", late).groupBy("song_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("song_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
