"""Scalar expressions: each takes columns and gives a column, so all of them stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import LANGUAGES, NOTE_NAMES, SCALES, lookup, names

#: Phrases dropped from titles, characters of sanitised file names.
TITLE_PHRASES = ["official video", "official music video", "Offizielles Musikvideo"]


def file_bpm(real: Column) -> Column:
    return real / 4


def real_bpm(file: Column) -> Column:
    return file * 4


def second_to_beat(seconds: Column, bpm: Column) -> Column:
    return seconds * bpm / 60


def beat_to_second(beats: Column, bpm: Column) -> Column:
    return beats * 60 / bpm


def decimal(text: Column) -> Column:
    """A number written with a decimal point or comma."""
    return F.replace(text, F.lit(","), F.lit(".")).cast("double")


def note_second(beat: Column, bpm: Column, gap: Column) -> Column:
    """Second at which a beat of a file begins; bpm and gap as the file writes them."""
    return beat_to_second(beat.cast("int").cast("double"), decimal(bpm) * 4) + decimal(gap) / 1000


def midi_to_file_pitch(midi: Column) -> Column:
    return midi - 48


def hz_to_midi(hz: Column) -> Column:
    """Null for a frequency of 0 or less."""
    return F.when(hz > 0, F.rint(12 * (F.log2(hz) - F.log2(F.lit(440.0))) + 69).cast("int"))


def midi_to_name(midi: Column) -> Column:
    return F.concat(F.element_at(names(), F.pmod(midi, F.lit(12)) + 1), (F.floor(midi / F.lit(12)) - 1).cast("string"))


def name_to_midi(name: Column) -> Column:
    """The number of a note name with its octave (sharps); null for anything else."""
    pc = F.array_position(names(), F.regexp_extract(name, r"^([A-G]#?)(-?[0-9]+)$", 1)) - 1
    octave = F.regexp_extract(name, r"^([A-G]#?)(-?[0-9]+)$", 2).try_cast("int")
    return F.when((pc >= 0) & octave.isNotNull(), (octave + 1) * 12 + pc).cast("int")


def name_to_file_pitch(name: Column) -> Column:
    return midi_to_file_pitch(name_to_midi(name))


def midi_to_hz(midi: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (midi - 69) / F.lit(12.0))


def note_length(bpm: Column, quarters: float) -> Column:
    """Seconds of a note: quarters is 4 for a whole note, 0.125 for a thirty-second."""
    return F.lit(60.0) / bpm * F.lit(quarters)


def beat_multiplier(bpm: Column) -> Column:
    """One less than the smallest multiple that reaches 400 beats a minute."""
    return F.when(bpm > 0, F.greatest(F.ceil(F.lit(400.0) / bpm) - 1, F.lit(0)).cast("int")).otherwise(F.raise_error(F.lit("bpm must be positive")).cast("int"))


def bpm_text(bpm: Column) -> Column:
    """As a file has it: two decimals at most, one at least, rounded by the number's exact binary value, without exponent.

    Only an eighth can lie halfway between two hundredths, then the even one is taken. From 10^13 on there is no hundredth to round.
    """
    size = F.abs(bpm)
    whole = F.floor(size).cast("long")
    scale = 1 << 60  # the part after the point times this is an integer, but for numbers that round to 0 anyway
    m = ((size - whole) * float(scale)).cast("long").cast("decimal(20,0)")
    cents = F.floor(m * 100 / F.lit(scale).cast("decimal(20,0)")).cast("long")
    twice, middle = m * 200, (2 * cents + 1).cast("decimal(20,0)") * F.lit(scale).cast("decimal(20,0)")
    up = (twice > middle) | ((twice == middle) & (cents % 2 == 1))
    cents = whole * 100 + cents + F.when(up, 1).otherwise(0)
    text = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.regexp_replace(F.lpad((cents % 100).cast("string"), 2, "0"), "0$", ""))
    return F.when(size < 1e13, F.concat(F.when(bpm < 0, "-").otherwise(""), text)).otherwise(bpm.cast("string"))


def half_even(x: Column) -> Column:
    return F.rint(x).cast("int")


def gap_ms(start: Column) -> Column:
    return (start * 1000).cast("int")


def sheet_quarters(seconds: Column) -> Column:
    return F.greatest(F.rint(seconds * 4) / 4, F.lit(0.25))


def plain_accidentals(name: Column) -> Column:
    return F.translate(name, "♯♭", "#b")


def frame_index(seconds: Column, rate: Column, channels: Column) -> Column:
    return (seconds * rate * channels).cast("long")


def without_stops(word: Column) -> Column:
    return F.translate(word, ".,", "")


def clean(text: Column) -> Column:
    """Without ASCII punctuation, lower case, trimmed."""
    return F.trim(F.lower(F.regexp_replace(text, r"[!-/:-@\[-`{-~]", "")))


_MARKS = r"[!-/:-@\[-`{-~]"


def punctuated(word: Column) -> Column:
    return word.rlike(_MARKS)


def bare(word: Column) -> Column:
    """Without ASCII punctuation and blanks."""
    return F.regexp_replace(word, r"[!-/:-@\[-`{-~ ]", "")


def marked_syllables(word: Column, syllables: Column) -> Column:
    """Syllables of the bare word with the word's marks put back: at most one before a letter, what is left after the last.

    Null without at least two syllables, or for a bare word of over 100 letters.
    """
    marks = F.regexp_replace(word, r"[^!-/:-@\[-`{-~ ]", "")
    count = F.aggregate(syllables, F.lit(0), lambda n, s: n + F.length(s))
    # A mark that stands before a letter is put there together with it, so a step takes two characters of the word, else one.
    steps = F.slice(F.regexp_extract_all(word, F.lit(r"(?s)[!-/:-@\[-`{-~ ].?|[^!-/:-@\[-`{-~ ]"), F.lit(0)), F.lit(1), count)
    hits = F.filter(F.transform(steps, lambda x, i: F.when(x.rlike(r"^[!-/:-@\[-`{-~ ]"), i)), lambda i: i.isNotNull())

    def closed(own: Column, left: Column) -> Column:
        return F.transform(own, lambda s, k: F.when(k == F.size(own) - 1, F.concat(s, left)).otherwise(s))

    def put(at: Column) -> Column:
        def marked(s: Column, k: Column) -> Column:
            before = F.aggregate(F.slice(syllables, F.lit(1), k), F.lit(0), lambda n, x: n + F.length(x))
            one = lambda c, j: F.concat(F.substr(marks, F.array_position(at, before + j), F.when(F.array_contains(at, before + j), 1).otherwise(0)), c)
            return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), one), "")

        return closed(F.transform(syllables, marked), F.substr(marks, F.size(at) + 1, F.length(marks)))

    # Where the first mark comes after as many letters as the syllables have, all marks go to the end.
    first = F.length(F.regexp_extract(word, r"^[^!-/:-@\[-`{-~ ]*", 0))
    # hits are worked out once for a row, as the only element of an array.
    out = F.when(first >= count, closed(syllables, marks)).when(count >= 0, F.get(F.transform(F.array(hits), put), F.lit(0)))
    return F.when((F.size(syllables) > 1) & (F.length(bare(word)) <= 100), out)


def plain_title(text: Column) -> Column:
    out = F.lower(text)
    for phrase in TITLE_PHRASES:
        out = F.replace(out, F.lit(phrase.lower()), F.lit(""))
    return F.trim(out)


def year(date: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(date, r"\b\d{4}\b", 0), F.lit("")), date)


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def genres(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.translate(text, ";/", ",,"), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.array_join(F.transform(F.split(p, "-"), _capital), "-")), ", ")


def tag_list(tags: Column) -> Column:
    """Names of tags, each with a comma after it; null without tags."""
    return F.when(F.size(tags) > 0, F.concat(F.array_join(F.transform(tags, lambda t: F.trim(t)), ","), F.lit(",")))


def language_name(code: Column) -> Column:
    return lookup(LANGUAGES, code)


def version_in(names: Column) -> Column:
    """Number after the program's name in the first of the names that has one; -1 without."""
    found = F.filter(names, lambda n: n.rlike(r"MuseScore\s+\d+"))
    return F.coalesce(F.regexp_extract(F.get(found, F.lit(0)), r"MuseScore\s+(\d+)", 1).try_cast("int"), F.lit(-1))


def video_title(artist: Column, track: Column, title: Column, channel: Column) -> Column:
    """artist and title of a video: its own fields, else the first two parts of a title with a dash, else channel and title."""
    parts = F.split(title, "-")
    own = F.struct(F.trim(artist).alias("artist"), F.trim(track).alias("title"))
    cut = F.struct(F.trim(F.get(parts, F.lit(0))).alias("artist"), F.trim(F.get(parts, F.lit(1))).alias("title"))
    return F.when(artist.isNotNull(), own).when(F.contains(title, F.lit("-")), cut).otherwise(F.struct(F.trim(channel).alias("artist"), F.trim(title).alias("title")))


def file_name(text: Column) -> Column:
    out = F.translate(text, '<>/\\|*?:"', "()----")
    return F.when(F.endswith(out, F.lit(".")), F.regexp_replace(out, r"[ .]+$", "")).otherwise(out)


def alphanumeric(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]+", "")


def snake(text: Column) -> Column:
    parts = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "-", " "), "([A-Z]+)", " $1"), "([A-Z][a-z]+)", " $1")
    return F.lower(F.regexp_replace(F.trim(parts), r"\s+", "_"))


def clock(seconds: Column) -> Column:
    ms = F.rint(seconds * 1000).cast("long")
    return F.format_string("%d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def allowed_notes(root: Column, mode: str) -> Column:
    return F.transform(F.array(*[F.lit(i) for i in SCALES[mode]]), lambda i: F.element_at(names(), F.pmod(root + i, F.lit(len(NOTE_NAMES))) + 1))


def crop(width: Column, height: Column) -> Column:
    """left, top and side of the centred square."""
    side = F.least(width, height)
    return F.struct(F.floor((width - side) / 2).alias("left"), F.floor((height - side) / 2).alias("top"), side.alias("side"))


#: What a suffix of a version number ranks as; a release without one is 0.
_SUFFIXES = {"dev": -4, "a": -3, "alpha": -3, "b": -2, "beta": -2, "c": -1, "rc": -1, "pre": -1, "preview": -1, "post": 1, "rev": 1, "r": 1}
_VERSION = r"(?i)^\s*v?(\d+(?:\.\d+)*)(?:[-_.]?(dev|alpha|a|beta|b|preview|pre|rc|c|post|rev|r)[-_.]?(\d*))?\s*$"


def version_key(version: Column) -> Column:
    """numbers (without zeros at the end), rank and number of the suffix: in the order of versions; null for anything else."""
    part = lambda k: F.regexp_extract(version, _VERSION, k)
    numbers = F.transform(F.split(F.regexp_replace(part(1), r"(\.0+)+$", ""), r"\."), lambda x: x.try_cast("long"))
    rank = F.coalesce(lookup({k: str(v) for k, v in _SUFFIXES.items()}, F.lower(part(2))).cast("int"), F.lit(0))
    return F.when(version.rlike(_VERSION), F.struct(numbers.alias("numbers"), rank.alias("rank"), F.coalesce(part(3).try_cast("long"), F.lit(0).cast("long")).alias("n")))


def at_least(version: Column, other: str) -> Column:
    """Whether a version is another one or a later one: missing parts are 0, a release candidate comes before its release. False for what is no version; null stays null."""
    return F.when(version.isNotNull(), F.coalesce(version_key(version) >= version_key(F.lit(other)), F.lit(False)))


def note_type(tag: Column) -> Column:
    return F.when(tag.isin(":", "R", "G", "F", "*"), tag).otherwise(F.raise_error(F.concat(F.lit("unknown note type "), tag)))
