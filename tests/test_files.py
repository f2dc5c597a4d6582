"""Karaoke files as other readers and writers take them, sheets, names, reports."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from notewright.functions import expr as E
from notewright.operators import music as MU
from notewright.plans import queries as plans
from notewright.plans import songs as more  # noqa: F401
from notewright.sources import exports as EX
from notewright.sources import karaoke_txt as K
from notewright.sources import tables as TB


def lines_of(spark, songs):
    return spark.createDataFrame([(s, i, x) for s, text in songs.items() for i, x in enumerate(text)], "song_id string, line_no int, line string")


def test_headers_of_both_kinds_of_readers(spark):
    text = ["#ARTIST: A: B", "#VIDEO:v.mp4", "#VIDEOGAP:3", "#VIDEOURL:https://x/y", "#COVER:c.jpg", "#COVERURL:https://c", "#BACKGROUNDURL:http://b", "#GAP:1", "#GAP:2", "#TITLE", "#BPM:120,5", "#YEAR:1999", ": 0 1 2 la"]
    lines = lines_of(spark, {"s": text, "t": ["#AUDIOURL:u:v", "x"]})
    strict, loose = ({r.song_id: r for r in K.headers(lines, compat).collect()} for compat in (False, True))
    assert (strict["s"].artist, strict["s"].video, strict["s"].videogap, strict["s"].cover, strict["s"].background, strict["s"].gap, strict["s"].title) == ("A: B", "v.mp4", "3", "c.jpg", None, "2", None)
    assert (loose["s"].artist, loose["s"].video, loose["s"].videogap, loose["s"].cover, loose["s"].background, loose["s"].gap, loose["s"].title) == (" A", "https", None, "https", "http", "2", None)
    assert (strict["t"].audio, loose["t"].audio, loose["s"].bpm) == (None, "u", "120,5")


def test_pitches_of_all_note_lines(spark):
    """Each `:` line gets its own note; the older way slips by the golden lines between."""
    lines = lines_of(spark, {"s": ["#BPM:1", ": 0 1 5 a", "* 1 1 5 b", ": 2 1 5 c", "- 3", "F 4 1 5 d", ": 5 1 5 e f", "E"]})
    notes = spark.createDataFrame([("s", k, n) for k, n in enumerate(["C3", "C#3", "D3", "D#3", "E3"])], "song_id string, seq int, note string")
    want = ["#BPM:1", ": 0 1 0 a", "* 1 1 5 b", ": 2 1 {} c", "- 3", "F 4 1 5 d", ": 5 1 {} e f", "E"]
    for compat, found in ((False, (2, 4)), (True, (1, 2))):
        got = [r.line for r in K.repitched_lines(lines, notes, compat).orderBy("line_no").collect()]
        it = iter(found)
        assert got == [x.format(next(it)) if "{}" in x else x for x in want]


def test_segments_of_note_lines(spark):
    lines = lines_of(spark, {"s": ["#BPM:60", "#GAP:500", ": 4 2 12 la", "* 8 4 -1 ~"]})
    got = [tuple(r) for r in K.segments(K.note_lines(lines)).orderBy("seq").collect()]
    assert got == [("s", 2, "C4", 1.5, 2.0, "la"), ("s", 3, "B2", 2.5, 3.5, "~")]


def test_sheet_has_bars_ties_and_a_head(spark):
    rows = [("s", 0, 60, 0.0, 3.5, "long "), ("s", 1, 61, 0.0, 1.0, "a&b "), ("s", 2, 62, 0.0, 8.2, "very "), ("s", 3, 63, 0.0, 0.01, "x"), ("t", 0, 69, 0.0, 4.0, "one")]
    notes = spark.createDataFrame(rows, "song_id string, seq int, midi int, start double, end double, word string")
    songs = spark.createDataFrame([("s", "T<1>", "A & B", 120.7), ("none", "x", "y", 1.0)], "song_id string, title string, artist string, bpm double")
    got = {r.song_id: ET.fromstring(r.xml) for r in EX.sheet(notes, songs).collect()}
    assert set(got) == {"s", "t"} and got["t"].find("work") is None
    s = got["s"]
    assert s.find("work/work-title").text == "T<1>" and s.find("identification/creator").text == "A & B" and s.find(".//sound").get("tempo") == "120"
    bars = s.findall(".//measure")
    assert [b.get("number") for b in bars] == ["1", "2", "3", "4"]
    assert all(sum(int(n.find("duration").text) for n in b.findall("note")) == 16 for b in bars)
    sung = [n for n in s.iter("note") if n.find("rest") is None]
    assert [n.find("lyric/text").text for n in sung if n.find("lyric") is not None] == ["long", "a&b", "very", "x"]
    assert sum(int(n.find("duration").text) for n in sung) == 14 + 4 + 33 + 1
    ties = [[t.get("type") for t in n.findall("tie")] for n in sung]
    assert ties.count(["start"]) == 2 and ties.count(["stop"]) == 2 and ties.count(["stop", "start"]) == 1
    assert [n.find("pitch/alter") is not None for n in sung if n.find("pitch/step").text == "C"] == [False, True, True]
    assert len(got["t"].findall(".//measure")) == 1


def test_names_run_out(spark, tmp_path):
    songs = spark.createDataFrame([(i, "n") for i in range(5)] + [(9, "m"), (10, None)], "song_id int, name string")
    assert sorted((r.song_id, r.name) for r in TB.unused_names(songs).collect()) == [(0, "n"), (1, "n (1)"), (2, "n (2)"), (3, "n (3)"), (4, "n (4)"), (9, "m"), (10, None)]
    with pytest.raises(Exception, match="no unused name for n"):
        TB.unused_names(songs, 3).collect()
    songs.write.parquet(f"{tmp_path}/cache/a")
    (tmp_path / "MuseScore 4").mkdir()
    assert TB.names_in(spark, str(tmp_path)) == ["MuseScore 4", "cache"] and TB.names_in(spark, f"{tmp_path}/none") == []
    found = spark.createDataFrame([(TB.names_in(spark, str(tmp_path)),)], "names array<string>").select(E.version_in(F.col("names")).alias("v"))
    assert found.first().v == 4
    assert TB.remove_folder(spark, f"{tmp_path}/cache") and not TB.remove_folder(spark, f"{tmp_path}/cache") and TB.names_in(spark, str(tmp_path)) == ["MuseScore 4"]


def test_report(spark):
    scores = spark.createDataFrame([("s", "accurate", 9000, 4500, 10, 500, 5010), ("s", "simple", 9000, 9000, 20, 1000, 10020)], "song_id string, granularity string, max_score int, notes int, golden int, line_bonus int, score int")
    assert MU.report(scores).first().text == "Simple (octave high ignored) points\nTotal: 10020, notes: 9000, line bonus: 1000, golden notes: 20\nAccurate (octave high matches) points\nTotal: 5010, notes: 4500, line bonus: 500, golden notes: 10"


def test_queries_without_sql_parse(spark):
    """The drawn plots of the events are pictures, and the alignment places words in order inside their songs."""
    d = "/root/testdata/sf0.001"
    plots = plans.QUERIES["q_pitch_plot"](spark, d).collect()
    assert plots and all(ET.fromstring(r.svg).tag.endswith("svg") for r in plots)
    words = plans.QUERIES["q_forced_alignment"](spark, d).collect()
    by = {}
    for r in sorted(words, key=lambda r: (r.song_id, r.seq)):
        if r.start is not None:
            assert r.start < r.stop and 0 <= r.score <= 1 and by.get(r.song_id, 0.0) <= r.start
            by[r.song_id] = r.stop
    assert len(by) > 5
