"""Operators along a song: recurrences as prefix scans, islands, gaps, fills. One exchange on song_id serves a chain of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import expr as E


def along(*order: str) -> W:
    return W.partitionBy("song_id").orderBy(*order)


def beat_scan(notes: DataFrame, order: str = "seq") -> DataFrame:
    """start_beat of notes(song_id, seq, want, length): no note begins before the one before it ends.

    s(i) = max(want(i), s(i-1) + length(i-1)) with s at least 0 is a max-plus prefix scan: the lengths before i plus the
    largest of 0 and want - lengths before, up to i.
    """
    w = along(order)
    before = F.coalesce(F.sum("length").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = notes.withColumn("_d", before)
    lead = F.max(F.col("want") - F.col("_d")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return out.withColumn("start_beat", F.col("_d") + F.greatest(F.lit(0), lead)).drop("_d")


def islands(rows: DataFrame, same: Column, order: str = "seq") -> DataFrame:
    """rows with island: how many rows up to here do not continue the one before; same: whether a row does (null: no)."""
    return rows.withColumn("island", F.sum(F.when(same, 0).otherwise(1)).over(along(order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def note_islands(notes: DataFrame, value: str = "note") -> DataFrame:
    w = along("seq")
    marked = islands(notes.withColumn("_same", F.col(value) == F.lag(value).over(w)), F.col("_same"))
    return marked.groupBy("song_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first(value).alias(value), F.count("*").alias("n")).drop("_same")


def silence_islands(frames: DataFrame, quiet: Column, least: float) -> DataFrame:
    """Stretches of quiet frames(song_id, frame_idx, t) of at least `least` seconds."""
    marked = islands(frames.withColumn("_q", quiet), F.col("_q") & F.lag("_q").over(along("frame_idx")), "frame_idx").filter("_q")
    out = marked.groupBy("song_id", "island").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    return out.filter(F.col("end") - F.col("start") >= least).select("song_id", "start", "end")


def gaps(notes: DataFrame) -> DataFrame:
    """notes with gap: seconds to the next note's start; null at the end."""
    return notes.withColumn("gap", F.lead("start").over(along("seq")) - F.col("end"))


def gap_deviation(parts: DataFrame) -> DataFrame:
    """Mean of the gaps(song_id, gap) but those equal to the largest; 0 for fewer than five gaps or no sum."""
    p = parts.filter(F.col("gap").isNotNull())
    top = p.withColumn("_top", F.max("gap").over(W.partitionBy("song_id")))
    out = top.groupBy("song_id").agg(F.count("*").alias("_n"), F.sum("gap").alias("_s"), F.avg(F.when(F.col("gap") < F.col("_top"), F.col("gap"))).alias("_m"))
    return out.select("song_id", F.when((F.col("_n") >= 5) & (F.col("_s") != 0), F.coalesce("_m", F.lit(0.0))).otherwise(F.lit(0.0)).alias("deviation"))


def filled_times(words: DataFrame) -> DataFrame:
    """words(song_id, seq, start, end) with missing times filled: 0.1 s after the end before, 0.1 s long, chained."""
    w = along("seq")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = words.withColumns({"_known": F.last("end", ignorenulls=True).over(upto), "_seen": F.count("end").over(upto)})
    k = F.row_number().over(W.partitionBy("song_id", "_seen").orderBy("seq")) - F.when(F.col("_seen") > 0, 1).otherwise(0)
    out = out.withColumn("_k", k)
    begin = F.when(F.col("_seen") > 0, F.col("_known") + F.lit(0.2) * F.col("_k") - 0.1).otherwise(F.lit(0.2) * (F.col("_k") - 1))
    stop = F.when(F.col("_seen") > 0, F.col("_known") + F.lit(0.2) * F.col("_k")).otherwise(F.lit(0.2) * (F.col("_k") - 1) + 0.1)
    missing = F.col("end").isNull()
    return out.withColumns({"start": F.when(missing, begin).otherwise(F.col("start")), "end": F.when(missing, stop).otherwise(F.col("end"))}).drop("_known", "_seen", "_k")


def gap_markers(frames: DataFrame, step: float) -> DataFrame:
    """frames(song_id, frame_idx, t, freq) with a NaN row before each row that comes more than step after the one before."""
    late = F.col("t") - F.lag("t").over(along("frame_idx")) > step
    row = F.struct(F.col("frame_idx"), F.col("t"), F.col("freq"), F.lit(False).alias("marker"))
    hole = F.struct(F.col("frame_idx"), F.col("t"), F.lit(float("nan")).alias("freq"), F.lit(True).alias("marker"))
    frames = frames.withColumn("_late", late)
    return frames.select("song_id", F.explode(F.when(F.col("_late"), F.array(hole, row)).otherwise(F.array(row))).alias("r")).select("song_id", "r.*")


def line_breaks(notes: DataFrame, deviations: DataFrame) -> DataFrame:
    """Where a phrase ends: notes(song_id, seq, word, start, end) with breaks after words that end in a blank.

    A word is the notes up to one whose word ends in a blank. A break follows if its last gap is over the deviation (which is
    not 0, and the note not the last), or if any gap before it within the word is.
    """
    w = along("seq")
    ends = F.col("word").endswith(" ")
    n = notes.withColumns({"_end": ends, "_last": F.lead("seq").over(w).isNull(), "_gap": F.coalesce(F.lead("start").over(w) - F.col("end"), F.lit(0.0))})
    n = n.withColumn("_word", F.coalesce(F.sum(F.col("_end").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    n = n.join(deviations, "song_id")
    inner = F.coalesce(F.max(F.when(~F.col("_end"), F.col("_gap") > F.col("deviation"))).over(W.partitionBy("song_id", "_word")), F.lit(False))
    broke = F.col("_end") & ((~F.col("_last") & (F.col("deviation") != 0) & (F.col("_gap") > F.col("deviation"))) | inner)
    return n.withColumn("line_break", broke).drop("_end", "_last", "_gap", "_word", "deviation")


def merged_syllables(tokens: DataFrame) -> DataFrame:
    """tokens(song_id, seq, word, start, end, is_hyphen, is_word_end, note, midi, bpm) with pieces of one note joined.

    A `~` piece joins the one before it if the note is the same or slides by at most two steps within two sixteenths; another
    piece joins if the note is the same and the one before ends no word; never across a breath longer than a sixteenth.
    """
    w = along("seq")
    t = tokens.withColumns({
        "_same": F.col("note") == F.lag("note").over(w), "_prev": F.lag("note").over(w),
        "_breath": F.col("start") - F.lag("end").over(w) > 60.0 / F.col("bpm") / 4, "_tilde": F.trim("word") == "~",
        "_open": ~F.lag("is_word_end").over(w),
        "_step": F.abs(F.col("midi") - F.lag("midi").over(w)),
    })
    t = t.withColumn("_slide", F.col("_tilde") & (F.col("end") - F.col("start") <= 2 * (60.0 / F.col("bpm") / 4)) & F.col("_step").between(1, 2))
    t = t.withColumn("_join", F.coalesce(~F.col("_breath") & F.when(F.col("_tilde"), F.col("_same") | F.col("_slide")).otherwise(F.col("_same") & F.col("_open")), F.lit(False)))
    t = islands(t, F.col("_join"))
    fields = ["seq", "word", "start", "end", "note", "_prev", "_tilde", "_slide", "_same", "is_hyphen", "is_word_end"]
    g = t.groupBy("song_id", "island").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("p"))
    blank = lambda s: F.endswith(s, F.lit(" "))
    state = lambda word, hyphen, end: F.struct(word.alias("word"), hyphen.alias("is_hyphen"), end.alias("is_word_end"))

    def fold(s: Column, x: Column) -> Column:
        cut = F.rtrim(x["word"])
        cur = F.when(F.startswith(cut, F.lit("~")), F.substr(cut, F.lit(2))).otherwise(cut)
        head = F.rtrim(s["word"])
        joined = F.concat(F.when(head == "~", F.lit("")).otherwise(head), cur, F.when(blank(x["word"]), F.lit(" ")).otherwise(F.lit("")))
        spaced = blank(x["word"])
        longer = F.when(spaced & ~blank(s["word"]), F.concat(s["word"], F.lit(" "))).otherwise(s["word"])
        tilde = state(longer, s["is_hyphen"], s["is_word_end"] | spaced)
        piece = state(joined, F.when(x["is_word_end"], F.lit(False)).otherwise(s["is_hyphen"] | x["is_hyphen"]), s["is_word_end"] | x["is_word_end"])
        return F.when(x["_tilde"], tilde).otherwise(piece)

    first = F.col("p")[0]
    folded = F.aggregate(F.slice("p", 2, F.size("p")), state(first["word"], first["is_hyphen"], first["is_word_end"]), fold)
    slides = F.filter(F.slice("p", 2, F.size("p")), lambda x: x["_slide"] & ~F.coalesce(x["_same"], F.lit(False)))
    g = g.withColumn("slides", slides).withColumn("slid", F.get("slides", F.size("slides") - 1))
    g = g.withColumn("f", folded)
    return g.select("song_id", first["seq"].alias("seq"), "f.word", first["start"].alias("start"), F.element_at("p", -1)["end"].alias("end"), F.coalesce(F.col("slid._prev"), first["note"]).alias("note"), "f.is_hyphen", "f.is_word_end")


def repitched(lines: DataFrame, pitches: DataFrame) -> DataFrame:
    """lines(song_id, line_no, line) with the pitch of each `: ` line replaced by pitches(song_id, line_no, pitch), if given."""
    out = lines.join(pitches, ["song_id", "line_no"], "left")
    parts = F.regexp_extract("line", r"^(:\s+\S+\s+\S+\s+)(\S+)(.*)$", 1), F.regexp_extract("line", r"^(:\s+\S+\s+\S+\s+)(\S+)(.*)$", 3)
    line = F.when(F.col("line").startswith(": ") & F.col("pitch").isNotNull(), F.concat(parts[0], F.col("pitch").cast("string"), parts[1])).otherwise(F.col("line"))
    return out.select("song_id", "line_no", line.alias("line"))


def beats(notes: DataFrame) -> DataFrame:
    """want and length in beats of notes(song_id, seq, start, end, bpm), as the file writes them, gap taken off."""
    first = F.min("start").over(W.partitionBy("song_id"))
    m = E.beat_multiplier(E.file_bpm(F.col("bpm")))
    at = lambda s: E.half_even(E.second_to_beat(s, F.col("bpm")) * m)
    return notes.withColumns({"want": at(F.col("start") - first), "length": at(F.col("end") - F.col("start"))})
