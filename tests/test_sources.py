"""Catalogue look-ups, plots, the chain of stages, table readers and writers."""

import json
import random
import time
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.operators import linkage as L
from notewright.plans import stages as ST
from notewright.sources import catalogue as C
from notewright.sources import exports as EX
from notewright.sources import karaoke_txt as K
from notewright.sources import media as M
from notewright.sources import tables as TB


def flaky(folder):
    """A transport that fails once, thrice or always, or never answers, by the query; it leaves a mark for each call."""

    def open_():
        import os
        import uuid

        def send(row):
            q = row["query"]
            calls = len([n for n in os.listdir(folder) if n.startswith(f"{q}.")])
            open(os.path.join(folder, f"{q}.{uuid.uuid4().hex}"), "w").close()
            if q == "silent":
                time.sleep(60)
            if q == "broken" or calls < {"once": 1, "twice": 2, "thrice": 3}.get(q, 0):
                raise OSError("no network")
            return None if q == "nothing" else json.dumps({"recording-list": [{"id": f"r{q}", "title": q.title()}]})

        return send

    return open_


def test_lookups_are_tried_three_times(spark, tmp_path):
    names = ["fine", "once", "twice", "thrice", "broken", "silent", "nothing", "fine"]
    queries = spark.createDataFrame([(n,) for n in names], "query string")
    got = {r["query"]: (r.answer, r.tries) for r in C.answers(queries, flaky(str(tmp_path)), wait=0.01, patience=0.5, block=2).collect()}
    assert set(got) == set(names) and {n: t for n, (_, t) in got.items()} == {"fine": 1, "once": 2, "twice": 3, "thrice": 3, "broken": 3, "silent": 3, "nothing": 1}
    assert {n for n, (a, _) in got.items() if a is None} == {"thrice", "broken", "silent", "nothing"} and json.loads(got["once"][0])["recording-list"][0]["title"] == "Once"
    assert len(list(tmp_path.iterdir())) == 1 + 2 + 3 + 3 + 3 + 3 + 1
    assert C.answers(queries.limit(0), flaky(str(tmp_path))).count() == 0


def test_tries_are_a_wait_apart():
    at = []
    assert C.asked(lambda: at.append(time.time()) or 1 / 0, 3, 0.2) == (None, 3)
    assert len(at) == 3 and all(0.2 <= b - a < 1 for a, b in zip(at, at[1:]))


def test_recordings_of_answers(spark):
    """From the answer's text to the linkage operators."""
    answer = {"recording-list": [
        {"id": "1", "title": "Other", "artist-credit-phrase": "X", "artist-credit": [{"artist": {"id": "ax"}}]},
        {"id": "2", "title": "Song", "artist-credit-phrase": "A & B", "artist-credit": [{"artist": {"id": "aa", "name": "A"}}, " & ", {"artist": {"id": "ab"}}], "release-list": [{"id": "l1", "release-group": {"id": "g1"}}]},
    ]}
    found = spark.createDataFrame([("q", json.dumps(answer)), ("w", None), ("v", "no json"), ("u", "{}")], "query string, answer string")
    rows = C.recordings(found)
    got = [(r["query"], r.ord, r.title, r.phrase, r.credits, [tuple(x) for x in r.releases or []]) for r in rows.orderBy("ord").collect()]
    assert got == [("q", 0, "Other", "X", ["ax"], []), ("q", 1, "Song", "A & B", ["aa", None, "ab"], [("l1", "g1")])]
    artists = spark.createDataFrame([("q", "ab")], "query string, artist string")
    assert [tuple(r) for r in L.catalogue_hit(rows, artists).collect()] == [("q", "Song", "ab")]


def test_plot_points_keep_every_pixel(spark):
    """The line through the kept points touches the same pixels of each column as that through all, and the picture is one."""
    rng = random.Random(3)
    rows = [("s", i, round(0.01 * i + (5.0 if i > 600 else 0), 3), 220 * 2 ** (rng.random() * 2), 1.0) for i in range(1000)] + [("one", 0, 3.0, 440.0, 1.0), ("none", 0, 1.0, 0.0, 1.0)]
    f = spark.createDataFrame(rows, "song_id string, frame_idx int, t double, freq double, conf double")
    kept = EX.plot_points(f, 40).collect()
    own = [r for r in rows if r[0] == "s"]
    low, high = own[0][2], own[-1][2]
    by = {}
    for _, i, t, hz, _ in own:
        by.setdefault(min(39, int((t - low) / (high - low) * 40)), []).append((t, np.log10(hz), i))
    want = {("s", px, *x) for px, all_ in by.items() for x in (min(all_), max(all_), min(all_, key=lambda v: v[1]), max(all_, key=lambda v: v[1]))} | {("one", 0, 3.0, np.log10(440.0), 0)}
    assert {(r.song_id, r.px, r.t, round(r.y, 9), r.frame_idx) for r in kept} == {(s, px, t, round(y, 9), i) for s, px, t, y, i in want} and len(kept) == len(want)
    words = spark.createDataFrame([("s", "R&B <3 ", 1.0), ("s", "late", 99.0)], "song_id string, word string, start double")
    pictures = {r.song_id: ET.fromstring(r.svg) for r in EX.pitch_plot(f, 40, 100, words=words).collect()}
    assert set(pictures) == {"s", "one"}
    tag = lambda name: "{http://www.w3.org/2000/svg}" + name
    path = pictures["s"].find(tag("path")).get("d")
    assert path.count("M") == 2 and path.count("M") + path.count("L") == len([r for r in kept if r.song_id == "s"])
    assert [t.text for t in pictures["s"].findall(tag("text"))] == ["R&B <3"]
    lines = pictures["s"].findall(tag("line"))
    assert len(lines) >= 24 and {x.get("stroke") for x in lines if x.find(tag("title")).text in ("C4", "C#4")} == {"red", "blue"}


def chain(fail_at=None, log=None):
    def stage(name, work):
        def run(todo, before):
            if log is not None:
                log.append((name, sorted(r.song_id for r in todo.select("song_id").collect())))
            if name == fail_at:
                raise RuntimeError(name)
            return work(todo, before)

        return name, run

    return [
        stage("heard", lambda todo, _: todo.select("song_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))),
        stage("noted", lambda todo, b: b["heard"].groupBy("song_id").agg(F.sum("k").alias("total"))),
        stage("named", lambda todo, b: b["noted"].join(todo, "song_id").select("song_id", F.concat(F.lit("t"), "total", F.lit("/"), "n").alias("name"))),
    ]


def told(tables):
    return {k: sorted(map(tuple, t.collect())) for k, t in tables.items()}


@pytest.mark.parametrize("stop", ["heard", "noted", "named"])
def test_a_stopped_chain_ends_the_same(spark, tmp_path, stop):
    songs = spark.createDataFrame([("a", 3), ("b", 1), ("c", 0)], "song_id string, n int")
    songs = songs.filter("n > 0")
    whole = told(ST.advanced(songs, chain(), f"{tmp_path}/whole"))
    assert whole["named"] == [("a", "t6/3"), ("b", "t1/1")]
    with pytest.raises(RuntimeError):
        ST.advanced(songs, chain(stop), f"{tmp_path}/part")
    log = []
    assert told(ST.advanced(songs, chain(log=log), f"{tmp_path}/part")) == whole
    order = ["heard", "noted", "named"]
    assert [n for n, _ in log] == order[order.index(stop) :]
    log.clear()
    assert told(ST.advanced(songs, chain(log=log), f"{tmp_path}/part")) == whole and log == []


def test_new_songs_and_songs_done_anew(spark, tmp_path):
    songs = lambda *rows: spark.createDataFrame(list(rows), "song_id string, n int")
    folder, log = str(tmp_path / "x"), []
    ST.advanced(songs(("a", 3), ("b", 1)), chain(), folder)
    out = told(ST.advanced(songs(("a", 3), ("b", 1), ("c", 2)), chain(log=log), folder))
    assert log == [(n, ["c"]) for n in ("heard", "noted", "named")] and out["named"] == [("a", "t6/3"), ("b", "t1/1"), ("c", "t3/2")]
    log.clear()
    changed = songs(("a", 3), ("b", 4), ("c", 2))
    out = told(ST.advanced(changed, chain(log=log), folder, {"heard": changed.filter("song_id = 'b'")}))
    assert log == [(n, ["b"]) for n in ("heard", "noted", "named")] and out["named"] == [("a", "t6/3"), ("b", "t10/4"), ("c", "t3/2")] and len(out["heard"]) == 9


def test_a_run_that_ended_between_its_two_tables(spark, tmp_path):
    """Rows of a stage whose songs were not noted as done are not read."""
    songs = spark.createDataFrame([("a", 2)], "song_id string, n int")
    whole = told(ST.advanced(songs, chain(), f"{tmp_path}/w"))
    spark.createDataFrame([("a", 77)], "song_id string, k int").write.parquet(f"{tmp_path}/p/heard/run=lost")
    assert told(ST.advanced(songs, chain(), f"{tmp_path}/p")) == whole


def test_injected_transcription(spark):
    x = np.zeros(1000)
    songs = spark.createDataFrame([("s", bytearray(M.wav_bytes(x, 1000))), ("t", bytearray(M.wav_bytes(x[:10], 1000)))], "song_id string, data binary")
    tokens = M.transcribed(songs, lambda: lambda x, rate: [("la", 0.0, len(x) / rate, 0.5), ("lo", 1.0, 2.0, 1.0)][: 2 if len(x) > 10 else 0])
    assert [tuple(r) for r in tokens.orderBy("seq").collect()] == [("s", 0, "la ", 0.0, 1.0, 0.5, False, True), ("s", 1, "lo ", 1.0, 2.0, 1.0, False, True)]


def test_text_files_as_lines_and_words(spark, tmp_path):
    """Lines by file whatever ends them, words in order within each file, a byte-order mark is no part of a word list's line."""
    (tmp_path / "a.txt").write_bytes(b"#ARTIST:A\r\n: 0 1 2 la \nE")
    (tmp_path / "b.txt").write_bytes(b"one  two\n\n\tthree\n")
    (tmp_path / "c.txt").write_bytes(b"")
    rows = [(r.song_id.rpartition("/")[2], r.line_no, r.line) for r in K.read_lines(spark, f"{tmp_path}/a.txt").orderBy("line_no").collect()]
    assert rows == [("a.txt", 0, "#ARTIST:A"), ("a.txt", 1, ": 0 1 2 la "), ("a.txt", 2, "E")]
    words = sorted((r.file.rpartition("/")[2], r.ord, r.word) for r in TB.read_words(spark, str(tmp_path)).filter("file like '%b.txt'").collect())
    assert words == [("b.txt", 0, "one"), ("b.txt", 1, "two"), ("b.txt", 2, "three")]


def test_csv_and_json_round_trips(spark, tmp_path):
    """Tokens and frames go out in order, a folder for each song, and come back as they were; so do cached results."""
    tokens = spark.createDataFrame([("s/1", 1, 'b, "x"', 1.0, 2.5, 0.5), ("s/1", 0, "a ", 0.25, 1.0, None), ("t", 0, "ü", 0.0, 1.0, 1.0)], "song_id string, seq int, word string, start double, end double, confidence double")
    TB.write_tokens_csv(tokens, f"{tmp_path}/tokens")
    back = TB.read_csv(spark, f"{tmp_path}/tokens")
    assert back.columns == ["word", "start", "end", "confidence", "song_id"]
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([("a ", "0.25", "1.0", None, "s/1"), ('b, "x"', "1.0", "2.5", "0.5", "s/1"), ("ü", "0.0", "1.0", "1.0", "t")], key=repr)
    assert [r.word for r in back.filter("song_id = 's/1'").collect()] == ["a ", 'b, "x"']
    frames = spark.createDataFrame([("s", 1, 0.5, 440.0, 0.9), ("s", 0, 0.0, 220.0, 1.0)], "song_id string, frame_idx int, t double, freq double, conf double")
    TB.write_frames_csv(frames, f"{tmp_path}/frames")
    assert [tuple(r) for r in TB.read_csv(spark, f"{tmp_path}/frames").collect()] == [("0.0", "220.0", "1.0", "s"), ("0.5", "440.0", "0.9", "s")]
    for k, df in enumerate((tokens, frames)):
        TB.write_json(df, f"{tmp_path}/json{k}")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        assert sorted(map(tuple, TB.read_json(spark, f"{tmp_path}/json{k}", schema).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
