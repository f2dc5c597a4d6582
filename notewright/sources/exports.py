"""What is derived for export: audio chunk manifests, plot ticks, MusicXML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import dims
from ..functions import expr as E


def chunk_manifest(tokens: DataFrame, rate: int, channels: int) -> DataFrame:
    """File and frame range of the audio chunk of each of tokens(song_id, seq, word, start, end)."""
    name = F.concat(F.lit("chunk_"), F.col("seq").cast("string"), F.lit("_"), E.alphanumeric(F.col("word")), F.lit(".wav"))
    at = lambda s: E.frame_index(F.col(s), F.lit(rate), F.lit(channels))
    return tokens.select("song_id", "seq", name.alias("file"), at("start").alias("first_frame"), at("end").alias("last_frame"))


def line_chunks(lines: DataFrame, rate: int, channels: int) -> DataFrame:
    """The same for note lines(song_id, line_no, word, start_time, end_time)."""
    return chunk_manifest(lines.select("song_id", F.col("line_no").alias("seq"), "word", F.col("start_time").alias("start"), F.col("end_time").alias("end")), rate, channels)


def step_sizes(frames: DataFrame) -> DataFrame:
    """song_id, step: the time of each song's second frame, for tracks that begin at 0."""
    n = F.row_number().over(W.partitionBy("song_id").orderBy("frame_idx"))
    return frames.withColumn("_n", n).filter("_n = 2").select("song_id", F.col("t").alias("step"))


def pitch_axis(frames: DataFrame, margin: float = 0.05) -> DataFrame:
    """song_id, note, y: the notes C0 to B8 whose log10 frequency is in the song's 1st to 99th percentile, a margin on both sides.

    The 108 notes are a table by rule, so this join is broadcast.
    """
    log = F.when(F.col("freq") > 0, F.log10("freq"))
    p = frames.groupBy("song_id").agg(F.percentile(log, F.array(F.lit(0.01), F.lit(0.99))).alias("p"))
    bounds = p.select("song_id", F.greatest(F.lit(0.0), F.col("p")[0] - margin).alias("_low"), (F.col("p")[1] + margin).alias("_high"))
    notes = dims.note_dim(frames.sparkSession).filter("octave between 0 and 8").select("note", F.log10("hz").alias("y"))
    return bounds.join(F.broadcast(notes), F.col("y").between(F.col("_low"), F.col("_high"))).select("song_id", "note", "y")


def time_ticks(frames: DataFrame, every: int) -> DataFrame:
    """Ticks of each song's time axis: the multiples of `every` seconds within it, and both ends."""
    ends = frames.groupBy("song_id").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    first, last = F.ceil(F.col("low") / every) * every, F.floor(F.col("high") / every) * every
    inner = F.when(first <= last, F.sequence(first, last, F.lit(every).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    ticks = F.array_sort(F.array_union(F.transform(inner, lambda x: x.cast("double")), F.array("low", "high")))
    return ends.select("song_id", F.posexplode(ticks).alias("tick_no", "tick"))


def escaped(text: Column) -> Column:
    """Text inside an XML element."""
    for mark, name in (("&", "amp"), ("<", "lt"), (">", "gt")):
        text = F.replace(text, F.lit(mark), F.lit(f"&{name};"))
    return text


def music_xml(notes: DataFrame) -> DataFrame:
    """song_id, xml: a one-part score of notes(song_id, seq, midi, start, end, word), durations to quarters of a beat."""
    step = F.substring(E.midi_to_name(F.col("midi")), 1, 1)
    alter = F.when(F.contains(E.midi_to_name(F.col("midi")), F.lit("#")), "<alter>1</alter>").otherwise("")
    word = escaped(F.trim("word"))
    note = F.concat(
        F.lit("<note><pitch><step>"), step, F.lit("</step>"), alter, F.lit("<octave>"), (F.floor(F.col("midi") / 12) - 1).cast("string"), F.lit("</octave></pitch><duration>"),
        (E.sheet_quarters(F.col("end") - F.col("start")) * 4).cast("long").cast("string"), F.lit("</duration><lyric><text>"), word, F.lit("</text></lyric></note>"),
    )
    songs = notes.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("seq", note.alias("x")))).alias("p"))
    head = '<score-partwise version="4.0"><part-list><score-part id="P1"><part-name>Vocals</part-name></score-part></part-list><part id="P1"><measure number="1"><attributes><divisions>4</divisions></attributes>'
    return songs.select("song_id", F.concat(F.lit(head), F.array_join(F.transform("p", lambda n: n["x"]), ""), F.lit("</measure></part></score-partwise>")).alias("xml"))


BAR, DIVISIONS = 4, 4


def sheet(notes: DataFrame, songs: DataFrame) -> DataFrame:
    """song_id, xml: notes(song_id, seq, midi, start, end, word) one after the other in bars of four quarters, with the title, composer and tempo of songs(song_id, title, artist, bpm).

    Durations are rounded to sixteenths, one at least; a note that passes a bar's end goes on tied in the next one, without its word. The last bar is
    filled up with a rest. Songs without notes give no sheet, notes without a song one without a head.
    """
    n = notes.withColumn("_q", E.sheet_quarters(F.col("end") - F.col("start")))
    n = n.withColumn("_to", F.sum("_q").over(W.partitionBy("song_id").orderBy("seq"))).withColumn("_from", F.col("_to") - F.col("_q"))
    bars = F.sequence(F.floor(F.col("_from") / BAR), F.ceil(F.col("_to") / BAR) - 1)
    n = n.withColumn("bar", F.explode(bars)).withColumns({"_a": F.greatest("_from", F.col("bar") * BAR), "_b": F.least("_to", (F.col("bar") + 1) * BAR)})
    name = E.midi_to_name(F.col("midi"))
    head, tail = F.col("_a") > F.col("_from"), F.col("_b") < F.col("_to")
    mark = lambda tag: F.concat(F.when(head, f'<{tag} type="stop"/>').otherwise(""), F.when(tail, f'<{tag} type="start"/>').otherwise(""))
    length = lambda q: (q * DIVISIONS).cast("long").cast("string")
    note = F.concat(
        F.lit("<note><pitch><step>"), F.substring(name, 1, 1), F.lit("</step>"), F.when(F.contains(name, F.lit("#")), "<alter>1</alter>").otherwise(""), F.lit("<octave>"), (F.floor(F.col("midi") / 12) - 1).cast("string"), F.lit("</octave></pitch><duration>"),
        length(F.col("_b") - F.col("_a")), F.lit("</duration>"), mark("tie"), F.when(head | tail, F.concat(F.lit("<notations>"), mark("tied"), F.lit("</notations>"))).otherwise(""), F.when(~head, F.concat(F.lit("<lyric><text>"), escaped(F.trim("word")), F.lit("</text></lyric>"))).otherwise(""), F.lit("</note>"),
    )
    by_bar = n.select("song_id", "bar", "seq", "_b", note.alias("x")).groupBy("song_id", "bar").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x"))), lambda v: v["x"]), "").alias("x"), F.max("_b").alias("_b"))
    left = (F.col("bar") + 1) * BAR - F.col("_b")
    rest = F.when(left > 0, F.concat(F.lit("<note><rest/><duration>"), length(left), F.lit("</duration></note>"))).otherwise("")
    both = by_bar.select("song_id", "bar", F.concat("x", rest).alias("x")).groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct("bar", "x"))).alias("bars"))
    both = both.join(songs.select("song_id", "title", "artist", "bpm"), "song_id", "left")
    part = lambda column, before, after: F.coalesce(F.concat(F.lit(before), escaped(F.col(column).cast("string")), F.lit(after)), F.lit(""))
    tempo = F.coalesce(F.concat(F.lit('<direction><direction-type><metronome><beat-unit>quarter</beat-unit><per-minute>'), F.col("bpm").cast("int").cast("string"), F.lit('</per-minute></metronome></direction-type><sound tempo="'), F.col("bpm").cast("int").cast("string"), F.lit('"/></direction>')), F.lit(""))
    first = F.concat(F.lit(f"<attributes><divisions>{DIVISIONS}</divisions><time><beats>{BAR}</beats><beat-type>4</beat-type></time></attributes>"), tempo)
    measures = F.array_join(F.transform("bars", lambda b: F.concat(F.lit('<measure number="'), (b["bar"] + 1).cast("string"), F.lit('">'), F.when(b["bar"] == 0, first).otherwise(""), b["x"], F.lit("</measure>"))), "")
    return both.select("song_id", F.concat(
        F.lit('<score-partwise version="4.0">'), part("title", "<work><work-title>", "</work-title></work>"), part("artist", '<identification><creator type="composer">', "</creator></identification>"),
        F.lit('<part-list><score-part id="P1"><part-name>Vocals</part-name></score-part></part-list><part id="P1">'), measures, F.lit("</part></score-partwise>"),
    ).alias("xml"))


def plot_points(frames: DataFrame, width: int, gap: float = float("inf")) -> DataFrame:
    """song_id, px, t, y, frame_idx, island: of each pixel column of a song's pitch track (log10 of the frequency) the first and last frame, the lowest and the highest.

    A line through them covers the same pixels as one through all frames; it is broken where island changes, frames more than
    gap seconds apart. Frames without a frequency above 0 are left out.
    """
    w = W.partitionBy("song_id").orderBy("t", "frame_idx")
    f = frames.filter(F.col("freq") > 0).select("song_id", "frame_idx", "t", F.log10("freq").alias("y"))
    f = f.withColumn("_far", (F.col("t") - F.lag("t").over(w) > gap).cast("int")).withColumn("island", F.coalesce(F.sum("_far").over(w), F.lit(0)))
    ends = f.groupBy("song_id").agg(F.min("t").alias("_low"), F.max("t").alias("_high"))
    share = F.when(F.col("_high") > F.col("_low"), (F.col("t") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    x = f.join(ends, "song_id").withColumn("px", F.least(F.floor(share * width), F.lit(width - 1)).cast("int"))
    row = F.struct("t", "y", "frame_idx", "island")
    early, late = F.struct("t", "frame_idx"), F.struct(F.col("y"), -F.col("t"), -F.col("frame_idx"))
    four = x.groupBy("song_id", "px").agg(F.min_by(row, early).alias("a"), F.max_by(row, early).alias("b"), F.min_by(row, F.struct("y", "t", "frame_idx")).alias("c"), F.max_by(row, late).alias("d"))
    return four.select("song_id", "px", F.inline(F.array_distinct(F.array("a", "b", "c", "d"))))


def pitch_plot(frames: DataFrame, width: int = 1200, height: int = 400, gap: float = 0.1, words: DataFrame | None = None, margin: float = 0.05) -> DataFrame:
    """song_id, svg: a song's pitch track over the lines of the notes in its range, C in red; broken where two frames are more than gap seconds apart.

    words(song_id, word, start): texts at the bottom of the second at which each begins. All drawn in the JVM; a song sends four
    points a pixel column at most.
    """
    points = plot_points(frames, width, gap)
    box = points.groupBy("song_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.greatest(F.lit(0.0), F.min("y") - margin).alias("y0"), (F.max("y") + margin).alias("y1"))
    span = F.when(F.col("t1") > F.col("t0"), F.col("t1") - F.col("t0")).otherwise(1.0)
    at_x, at_y = lambda t: F.round((t - F.col("t0")) / span * width, 2), lambda y: F.round((F.col("y1") - y) / (F.col("y1") - F.col("y0")) * height, 2)
    order = W.partitionBy("song_id").orderBy("t", "frame_idx")
    line = points.join(box, "song_id").withColumn("_far", F.coalesce(F.col("island") != F.lag("island").over(order), F.lit(True)))
    step = F.concat(F.when(F.col("_far"), F.lit("M")).otherwise(F.lit("L")), at_x(F.col("t")).cast("string"), F.lit(" "), at_y(F.col("y")).cast("string"))
    paths = line.select("song_id", "t", "frame_idx", step.alias("s")).groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct("t", "frame_idx", "s"))).alias("p"))
    path = F.concat(F.lit('<path fill="none" stroke="black" stroke-width="0.5" d="'), F.array_join(F.transform("p", lambda x: x["s"]), ""), F.lit('"/>'))
    colour = F.when(F.col("note").rlike("^C[0-9]"), "red").otherwise("blue")
    rule = F.concat(F.lit('<line x1="0" x2="'), F.lit(str(width)), F.lit('" y1="'), at_y(F.col("y")).cast("string"), F.lit('" y2="'), at_y(F.col("y")).cast("string"), F.lit('" stroke-width="0.2" stroke="'), colour, F.lit('"><title>'), F.col("note"), F.lit("</title></line>"))
    notes = dims.note_dim(frames.sparkSession).filter("octave between 0 and 8").select("note", F.log10("hz").alias("y"))
    rules = box.join(F.broadcast(notes), F.col("y").between(F.col("y0"), F.col("y1"))).select("song_id", "y", rule.alias("r")).groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct("y", "r"))).alias("r"))
    out = paths.join(rules, "song_id", "left")
    text = F.lit("")
    if words is not None:
        own = words.join(box, "song_id").filter(F.col("start").between(F.col("t0"), F.col("t1")))
        label = F.concat(F.lit('<text font-size="8" x="'), at_x(F.col("start")).cast("string"), F.lit(f'" y="{height}">'), escaped(F.trim("word")), F.lit("</text>"))
        out = out.join(own.groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct("start", label.alias("w")))).alias("w")), "song_id", "left")
        text = F.coalesce(F.array_join(F.transform("w", lambda x: x["w"]), ""), F.lit(""))
    head = F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">')
    return out.select("song_id", F.concat(head, F.coalesce(F.array_join(F.transform("r", lambda x: x["r"]), ""), F.lit("")), path, text, F.lit("</svg>")).alias("svg"))
