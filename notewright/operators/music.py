"""Keys and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import expr as E
from .joins import confident, in_index_range, in_range, index_ranges, modal

STEP = 0.09


def key_of(chroma: DataFrame) -> DataFrame:
    """key and mode of chroma(song_id, pc, weight): the template with the highest correlation, the first of equals; null weights and pitch classes count nothing.

    One shuffle: a song's twelve weights become one row, and its correlations with the 24 templates are sums over arrays.
    """
    at = lambda pc: F.coalesce(F.sum(F.when(F.col("pc") == pc, F.col("weight"))), F.lit(0.0))
    songs = chroma.groupBy("song_id").agg(F.array(*[at(pc) for pc in range(12)]).alias("x"))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    songs = songs.withColumns({"sx": total(F.col("x")), "sxx": total(F.transform("x", lambda v: v * v))})
    spread = 12 * F.col("sxx") - F.col("sx") * F.col("sx")

    def fit(shift: int, mode: str, order: int) -> Column:
        inside = [(i + shift) % 12 for i in dims.SCALES[mode]]
        n = len(inside)
        both = total(F.array(*[F.col("x")[pc] for pc in inside]))
        r = F.when(spread > 1e-12, (12 * both - F.col("sx") * n) / F.sqrt(spread * (12 * n - n * n)))
        return F.struct(F.round(r, 9).alias("near"), F.lit(-order).alias("before"), F.lit(shift).alias("shift"), F.lit(mode).alias("mode"), r.alias("r"))

    fits = F.array(*[fit(shift, mode, 2 * shift + k) for shift in range(12) for k, mode in enumerate(dims.SCALES)])
    best = songs.select("song_id", F.array_max(F.filter(fits, lambda f: f["r"].isNotNull())).alias("b")).filter(F.col("b").isNotNull())
    return best.select("song_id", F.element_at(dims.names(), F.col("b.shift") + 1).alias("key"), "b.mode", F.round("b.r", 6).alias("r"))


def quantized(notes: DataFrame, keys: DataFrame) -> DataFrame:
    """notes(song_id, midi, ...) moved to the nearest note of their song's key (song_id, shift, mode), the lower of two."""
    dim = F.broadcast(dims.quantize_dim(notes.sparkSession))
    n = notes.join(keys.select("song_id", "shift", "mode"), "song_id").withColumn("pc", F.pmod("midi", F.lit(12)))
    return n.join(dim, ["shift", "mode", "pc"]).withColumn("quantized", F.col("midi") + F.col("delta")).drop("pc", "delta")


def pitch_of(segments: DataFrame, frames: DataFrame, width: float = 1.0) -> DataFrame:
    """The modal midi note of the confident frames in each segment(song_id, seg, start, end)."""
    rows = in_range(segments, frames, width)
    return modal(confident(rows, ["song_id", "seg"]).withColumn("midi", E.hz_to_midi(F.col("freq"))), ["song_id", "seg"], "midi", "frame_idx")


def notes_of(segments: DataFrame, frames: DataFrame, width: float = 64) -> DataFrame:
    """The modal midi note of each segment's frames, from the one nearest to its start up to the one nearest to its end: no segment of a song with frames is without."""
    rows = in_index_range(index_ranges(segments, frames).select("song_id", "seg", "first_frame", "stop_frame"), frames.select("song_id", "frame_idx", "freq", "conf"), int(width))
    return modal(confident(rows, ["song_id", "seg"]).withColumn("midi", E.hz_to_midi(F.col("freq"))), ["song_id", "seg"], "midi", "frame_idx")


def score(lines: DataFrame, frames: DataFrame, width: float = 64, heard_by: Callable[..., DataFrame] = notes_of) -> DataFrame:
    """Scores of lines(song_id, line_no, note_type, word, pitch, start_time, end_time) sung as frames(song_id, frame_idx, t, freq, conf).

    Each note is cut into parts of STEP seconds; a part counts when its modal note is the line's (accurate) or has its pitch class
    (simple). Golden notes count double; a note with all parts hit earns its share of the 1000 points of line bonus. heard_by gives a
    part's note: notes_of from the frames nearest to its ends, at least one, so that each part of a song with frames hears a note; pitch_of from
    those within its time, which a short part may not have.
    """
    totals = lines.groupBy("song_id").agg(F.count("*").alias("_lines"))
    sung = lines.filter((F.col("word") != "") & (F.col("note_type") != "F"))
    sung = sung.withColumn("_parts", F.greatest(F.lit(1), ((F.col("end_time") - F.col("start_time")) / STEP).cast("int")))
    parts = sung.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    parts = parts.withColumns({
        "seg": F.struct("line_no", "part"), "start": F.col("start_time") + F.col("part") * STEP,
        "end": F.when(F.col("part") == F.col("_parts") - 1, F.col("end_time")).otherwise(F.col("start_time") + (F.col("part") + 1) * STEP),
    })
    heard = heard_by(parts.select("song_id", "seg", "start", "end"), frames, width).select("song_id", "seg", "midi")
    hit = parts.join(heard, ["song_id", "seg"], "left").withColumns({
        "_a": F.coalesce(F.col("midi") == F.col("pitch") + 48, F.lit(False)), "_s": F.coalesce(F.pmod("midi", F.lit(12)) == F.pmod(F.col("pitch") + 48, F.lit(12)), F.lit(False)),
    })
    by_line = hit.groupBy("song_id", "line_no", "note_type", "_parts").agg(F.count_if("_a").alias("accurate"), F.count_if("_s").alias("simple"))
    kinds = by_line.select("song_id", "note_type", "_parts", F.explode(F.create_map(F.lit("accurate"), F.col("accurate"), F.lit("simple"), F.col("simple"))).alias("granularity", "hits"))
    golden = F.col("note_type").isin("*", "G")
    sums = kinds.groupBy("song_id", "granularity").agg(
        F.sum("_parts").alias("parts"), F.sum(F.when(~golden, F.col("hits")).otherwise(0)).alias("n"), F.sum(F.when(golden, 2 * F.col("hits")).otherwise(0)).alias("g"), F.count_if(F.col("hits") == F.col("_parts")).alias("full")
    ).join(totals, "song_id")
    bonus = F.col("full") * (F.lit(1000.0) / F.col("_lines"))
    top = F.when(bonus == 0, 10000).otherwise(9000)
    notes = F.rint(top * F.col("n") / F.col("parts"))
    return sums.select("song_id", "granularity", top.alias("max_score"), notes.cast("int").alias("notes"), F.rint(F.col("g")).cast("int").alias("golden"), F.rint(bonus).cast("int").alias("line_bonus"), F.rint(notes + bonus + F.col("g")).cast("int").alias("score"))


def report(scores: DataFrame) -> DataFrame:
    """song_id, text: both scores of a song in words, the simple one (octaves ignored) first."""
    number = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("Total: "), number("score"), F.lit(", notes: "), number("notes"), F.lit(", line bonus: "), number("line_bonus"), F.lit(", golden notes: "), number("golden"))
    simple = F.col("granularity") == "simple"
    own = scores.select("song_id", F.when(simple, 0).otherwise(1).alias("k"), F.concat(F.when(simple, "Simple (octave high ignored)").otherwise("Accurate (octave high matches)"), F.lit(" points\n"), line).alias("t"))
    return own.groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct("k", "t"))).alias("p")).select("song_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"))
