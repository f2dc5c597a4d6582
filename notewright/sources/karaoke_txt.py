"""The karaoke text format as tables: reading, writing, new pitches, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import expr as E
from ..operators.sequences import repitched

#: Tags read, and headers written in this order with the first version that has them.
TAGS = ["ARTIST", "TITLE", "MP3", "AUDIO", "VIDEO", "GAP", "BPM", "VIDEOGAP", "COVER", "BACKGROUND"]
HEADER_ORDER = [("VERSION", "1.0.0"), ("ARTIST", None), ("TITLE", None), ("YEAR", None), ("LANGUAGE", None), ("GENRE", None), ("COVER", None), ("COVERURL", "1.2.0"), ("BACKGROUND", None), ("MP3", None), ("AUDIO", "1.1.0"), ("VOCALS", "1.1.0"), ("INSTRUMENTAL", "1.1.0"), ("VIDEO", None), ("VIDEOGAP", None), ("VIDEOURL", "1.2.0"), ("BPM", None), ("GAP", None), ("TAGS", "1.1.0"), ("CREATOR", None), ("COMMENT", None)]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """song_id (the file), line_no, line of text files."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("song_id"), "value")
    return whole.select("song_id", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def headers(lines: DataFrame, compat: bool = False) -> DataFrame:
    """One row a song, a column for each tag in TAGS: the text after the first colon of its last line, trimmed.

    compat: as older readers take them. A line belongs to the first of TAGS that its own tag begins with, so VIDEOGAP and VIDEOURL are
    VIDEO, COVERURL is COVER and so on, and its value is what stands between the first and the second colon, blanks and all.
    """
    own = lines.filter(F.col("line").startswith("#")).select("song_id", "line_no", F.regexp_extract("line", r"^#([^:]*)", 1).alias("tag"), "line")
    if compat:
        tag = F.coalesce(*[F.when(F.startswith("tag", F.lit(t)), t) for t in TAGS])
        tagged = own.filter(F.contains("line", F.lit(":"))).select("song_id", "line_no", tag.alias("tag"), F.split_part("line", F.lit(":"), F.lit(2)).alias("value"))
    else:
        tagged = own.select("song_id", "line_no", F.when(F.contains("line", F.lit(":")), F.col("tag")).alias("tag"), F.trim(F.regexp_extract("line", r"^#([^:]*):(.*)$", 2)).alias("value"))
    return tagged.groupBy("song_id").agg(*[F.max_by(F.when(F.col("tag") == t, F.col("value")), F.when(F.col("tag") == t, F.col("line_no"))).alias(t.lower()) for t in TAGS])


def note_lines(lines: DataFrame) -> DataFrame:
    """Notes with their seconds; words lose blanks at their ends. A song without BPM or GAP gives null times; what should be a number and is none, a null."""
    parts = lines.filter(F.col("line").rlike("^[:*FRG] ")).withColumn("p", F.split(F.trim("line"), r"\s+"))
    n = parts.select("song_id", "line_no", F.get("p", F.lit(0)).alias("note_type"), F.get("p", F.lit(1)).try_cast("double").alias("start_beat"), F.get("p", F.lit(2)).try_cast("double").alias("duration"), F.get("p", F.lit(3)).try_cast("int").alias("pitch"), F.coalesce(F.get("p", F.lit(4)), F.lit("")).alias("word"))
    n = n.join(headers(lines).select("song_id", "bpm", "gap"), "song_id", "left")
    at = lambda beat: E.note_second(beat, F.col("bpm"), F.col("gap"))
    return n.withColumns({"start_time": at(F.col("start_beat")), "end_time": at(F.col("start_beat") + F.col("duration"))}).drop("bpm", "gap")


def segments(notes: DataFrame) -> DataFrame:
    """song_id, seq, note, start, end, word of note lines, as they come from note_lines."""
    return notes.select("song_id", F.col("line_no").alias("seq"), E.midi_to_name(F.col("pitch") + 48).alias("note"), F.col("start_time").alias("start"), F.col("end_time").alias("end"), "word")


def _header_arrays(songs: DataFrame) -> DataFrame:
    """song_id, lines array<struct<ord, line>>: the headers of songs, gated by version, which is read once for all of them."""
    have = {c.upper().replace("_", "") if c != "video_url" else "VIDEOURL": c for c in songs.columns}
    gates = {since: f"_since_{k}" for k, since in enumerate(sorted({s for tag, s in HEADER_ORDER if s is not None and tag in have}))}
    if gates:
        songs = songs.withColumn("_key", E.version_key(F.col("version")))
        songs = songs.withColumns({name: F.coalesce(F.col("_key") >= E.version_key(F.lit(since)), F.lit(False)) for since, name in gates.items()})
    items = []
    for k, (tag, since) in enumerate(HEADER_ORDER):
        if tag in have:
            value = F.col(have[tag]).cast("string")
            ok = value.isNotNull() & (F.lit(True) if since is None else F.col(gates[since]))
            items.append(F.when(ok, F.struct(F.lit(k - 1000).alias("ord"), F.concat(F.lit(f"#{tag}:"), value).alias("line"))))
    return songs.select("song_id", F.array_compact(F.array(*items)).alias("lines"))


def header_lines(songs: DataFrame) -> DataFrame:
    """ord, line of the headers of songs (song_id, version, and a nullable column for each header), gated by version."""
    return _header_arrays(songs).select("song_id", F.explode("lines").alias("x")).select("song_id", "x.*")


def header_files(songs: DataFrame) -> DataFrame:
    """files(header_lines(songs)); a song's lines stay together, so a row for each song is dealt out instead of one for each line."""
    g = _header_arrays(songs).groupBy("song_id").agg(F.sort_array(F.flatten(F.collect_list("lines"))).alias("p")).filter(F.size("p") > 0)
    return g.select("song_id", _ended("p").alias("content"))


def note_text(notes: DataFrame) -> DataFrame:
    """ord, line of notes(song_id, seq, start_beat, length, pitch, word, line_break, break_beat), with their line breaks."""
    n = F.concat_ws(" ", F.lit(":"), F.col("start_beat").cast("string"), F.col("length").cast("string"), F.col("pitch").cast("string"), F.col("word"))
    rows = F.array(F.struct((2 * F.col("seq")).alias("ord"), n.alias("line")), F.when(F.col("line_break"), F.struct((2 * F.col("seq") + 1).alias("ord"), F.concat(F.lit("- "), F.col("break_beat").cast("string")).alias("line"))))
    return notes.select("song_id", F.explode(F.array_compact(rows)).alias("x")).select("song_id", "x.*")


def _ended(lines: str) -> Column:
    """The text of an array of (ord, line), with an `E` as its last line."""
    return F.concat(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\nE"))


def files(lines: DataFrame) -> DataFrame:
    """song_id, content: lines(song_id, ord, line) in order, then `E`, no line feed at the end."""
    g = lines.groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("p"))
    return g.select("song_id", _ended("p").alias("content"))


def with_score(lines: DataFrame, scores: DataFrame) -> DataFrame:
    """lines with each song's score text in its first comment line, or in a new one before its first note."""
    is_comment, is_note = F.col("line").startswith("#COMMENT:"), F.col("line").rlike("^[:*FRG] ")
    at = lines.groupBy("song_id").agg(F.min(F.when(is_comment, F.col("line_no"))).alias("_c"), F.min(F.when(is_note, F.col("line_no"))).alias("_n"))
    x = lines.join(at, "song_id").join(scores.select("song_id", "score"), "song_id", "left")
    old = F.when((F.col("line_no") == F.col("_c")) & F.col("score").isNotNull(), F.concat(F.col("line"), F.lit(" | "), F.col("score"))).otherwise(F.col("line"))
    new = F.when(F.col("_c").isNull() & (F.col("line_no") == F.col("_n")) & F.col("score").isNotNull(), F.struct((F.col("line_no") - 0.5).alias("ord"), F.concat(F.lit("#COMMENT:"), F.col("score")).alias("line")))
    row = F.struct(F.col("line_no").cast("double").alias("ord"), old.alias("line"))
    return x.select("song_id", F.explode(F.array_compact(F.array(new, row))).alias("r")).select("song_id", "r.*")


def retitled(path: Column) -> Column:
    """artist and title of a file's stem: `artist - title`, or a title alone."""
    stem = F.regexp_replace(F.regexp_extract(path, r"[^/\\]*$", 0), r"\.[^.]*$", "")
    two = F.split(stem, " - ", 2)
    return F.struct(F.when(F.size(two) == 2, two[0]).alias("artist"), F.element_at(two, -1).alias("title"))


def routed(inputs: DataFrame) -> DataFrame:
    """inputs(path) with kind: `repitch` for text files, `url` for https addresses, else `media`."""
    kind = F.when(F.endswith("path", F.lit(".txt")), "repitch").when(F.startswith("path", F.lit("https:")), "url").otherwise("media")
    return inputs.withColumn("kind", kind)


def located(heads: DataFrame, folder: str = "") -> DataFrame:
    """heads(song_id, artist, title, mp3, audio) with basename, audio_file, extension and found: mp3, else audio, else not found."""
    audio = F.coalesce(F.nullif(F.col("mp3"), F.lit("")), F.nullif(F.col("audio"), F.lit("")))
    name = F.concat_ws(" - ", F.trim("artist"), F.trim("title"))
    return heads.select("song_id", name.alias("basename"), F.concat(F.lit(folder), audio).alias("audio_file"), F.regexp_extract(audio, r"\.([^./\\\\]*)$", 1).alias("extension"), audio.isNotNull().alias("found"))


def song_headers(media: DataFrame, creator: str, karaoke: bool = False) -> DataFrame:
    """The header table of automatically made songs, a row for each file to write.

    media(song_id, basename, version, artist, title, year, genre, language, music_key, audio_extension, video_extension, video_url,
    cover_url, has_cover). A song of a version before 1.1.0 gets a second file for karaoke, if asked for, with the instrumental.
    """
    file = lambda kind, ext: F.concat(F.col("basename"), F.lit(kind), F.lit("."), F.col(ext))
    main = media.select(
        "song_id", F.lit("main").alias("variant"), "version", "artist", "title", E.year(F.col("year")).alias("year"), E.language_name(F.col("language")).alias("language"), E.genres(F.col("genre")).alias("genre"),
        F.when(F.col("has_cover"), F.concat("basename", F.lit(" [CO].jpg"))).alias("cover"), "cover_url", file("", "audio_extension").alias("mp3"), file("", "audio_extension").alias("audio"),
        file(" [Vocals]", "audio_extension").alias("vocals"), file(" [Instrumental]", "audio_extension").alias("instrumental"), file("", "video_extension").alias("video"), "video_url",
        F.concat(F.lit("key: "), "music_key").alias("tags"), F.lit(creator).alias("creator"), F.lit(creator).alias("comment"), F.concat("basename", F.lit(" [Karaoke]")).alias("_k"), "audio_extension",
    )
    other = main.filter(F.lit(karaoke) & ~E.at_least(F.col("version"), "1.1.0"))
    other = other.withColumns({"variant": F.lit("karaoke"), "title": F.col("_k"), "mp3": F.concat("_k", F.lit("."), "audio_extension")})
    return main.unionByName(other).drop("_k", "audio_extension")


def repitched_files(lines: DataFrame, notes: DataFrame) -> DataFrame:
    """song_id, content: lines(song_id, line_no, line) with the pitch of each `:` line replaced by that of the note(song_id, seq, note) of the same place among them."""
    order = F.row_number().over(W.partitionBy("song_id").orderBy("line_no")) - 1
    own = lines.filter(F.col("line").startswith(": ")).select("song_id", "line_no", order.alias("seq"))
    pitches = own.join(notes.select("song_id", "seq", E.name_to_file_pitch(F.col("note")).alias("pitch")), ["song_id", "seq"]).select("song_id", "line_no", "pitch")
    return verbatim(repitched(lines, pitches).withColumnRenamed("line_no", "ord"))


def repitched_lines(lines: DataFrame, notes: DataFrame, compat: bool = False) -> DataFrame:
    """lines(song_id, line_no, line) with the pitches of their `:` lines from notes(song_id, seq, note), one for each note line of any kind.

    compat: as older writers do it, `:` lines take the notes one after the other, also those of the golden, rap and freestyle lines
    between, so pitches slip by as many places.
    """
    own = lines.filter(F.col("line").rlike("^[:*FRG] ")).withColumn("_plain", F.startswith("line", F.lit(": ")))
    w = W.partitionBy("song_id").orderBy("line_no")
    seq = F.sum(F.col("_plain").cast("int")).over(w) - 1 if compat else F.row_number().over(w) - 1
    own = own.withColumn("seq", seq).filter("_plain").select("song_id", "line_no", "seq")
    pitches = own.join(notes.select("song_id", "seq", E.name_to_file_pitch(F.col("note")).alias("pitch")), ["song_id", "seq"]).select("song_id", "line_no", "pitch")
    return repitched(lines, pitches)


def verbatim(lines: DataFrame) -> DataFrame:
    """song_id, content: lines(song_id, ord, line) in order and nothing else."""
    g = lines.groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("p"))
    return g.select("song_id", F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("content"))


def audio_files(songs: DataFrame, karaoke: bool = False) -> DataFrame:
    """song_id, kind, file: the audio files that songs(song_id, basename, version, extension) get beside their text."""
    new = E.at_least(F.col("version"), "1.1.0")
    item = lambda ok, kind, source: F.when(ok, F.struct(F.lit(source).alias("kind"), F.concat("basename", F.lit(f" [{kind}]."), "extension").alias("file")))
    items = F.array(item(~new & F.lit(karaoke), "Karaoke", "instrumental"), item(new, "Instrumental", "instrumental"), item(new, "Vocals", "vocals"))
    return songs.select("song_id", F.inline(F.array_compact(items)))


def finished_files(automatic: DataFrame, given: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """song_id, content: the lines(song_id, line_no, line) of automatic and of re-pitched songs, with their scores(song_id, score) put in."""
    lines = automatic.unionByName(given)
    return verbatim(lines.withColumnRenamed("line_no", "ord") if scores is None else with_score(lines, scores))
