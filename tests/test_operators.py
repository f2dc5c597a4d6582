"""Golden cases and slow models of the operators that SQL does not express."""

import hashlib
import math
import random
import string

from pyspark.sql import Row
from pyspark.sql import functions as F

from notewright.functions import expr as E
from notewright.operators import generators as G
from notewright.operators import joins as J
from notewright.operators import linkage as L
from notewright.operators import music as M
from notewright.operators import sequences as S
from notewright.plans import queries as plans
from notewright.sources import karaoke_txt as K


def values(spark, column, rows):
    df = spark.createDataFrame([(r,) for r in rows], ["x"])
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def pieces(spark, tokens, silences):
    t = spark.createDataFrame([("s", i, w, float(a), float(b), True) for i, (w, a, b) in enumerate(tokens)], "song_id string, seq int, word string, start double, end double, is_word_end boolean")
    s = spark.createDataFrame([("s", float(a), float(b)) for a, b in silences], "song_id string, start double, end double")
    return [(r.word, r.start, r.end, r.is_word_end) for r in J.without_silence(t, s).orderBy("seq", "piece_no").collect()]


def test_silence_all_positions(spark):
    tokens = [("Before silence ", 1, 2), ("End is in silence ", 1, 5), ("Is in silence ", 3, 4), ("Start is in silence ", 5, 10), ("After silence ", 9, 10), ("Silence is inside ", 1, 12)]
    assert pieces(spark, tokens, [(2, 9)]) == [("Before silence ", 1, 2, True), ("End is in silence ", 1, 2, True), ("Start is in silence ", 9, 10, True), ("After silence ", 9, 10, True), ("Silence is inside", 1, 2, False), ("~ ", 9, 12, True)]


def test_many_silences_inside(spark):
    many = [(2, 3), (4, 5), (6, 7), (8, 9)]
    head = [("Silence is inside", 1, 2, False), ("~", 3, 4, False), ("~", 5, 6, False)]
    assert pieces(spark, [("Silence is inside ", 1, 12)], many) == [*head, ("~", 7, 8, False), ("~ ", 9, 12, True)]
    assert pieces(spark, [("Silence is inside ", 1, 9)], many) == [*head, ("~ ", 7, 8, True)]


def test_tiny_pieces(spark):
    silences = [(2, 2.1), (3.09, 3.1), (4, 4.09), (5, 5.09), (6, 6.09), (7, 7.09)]
    tokens = [("Remove split ", 1, 2.19), ("Is split ", 3, 4.1), ("Is split2 ", 5, 7.1)]
    assert pieces(spark, tokens, silences) == [("Remove split ", 1, 2, True), ("Is split ", 3.1, 4, True), ("Is split2", 5.09, 6, False), ("~ ", 6.09, 7, True)]


def test_years(spark):
    spelt = ["2023-12-31", "2023-12-31 23:59:59", "2023/12/31", "2023\\12\\31", "2023.12.31", "2023 12 31", "12-31-2023", "12/31/2023", "12\\31\\2023", "12.31.2023", "12 31 2023", "12-2023", "12/2023", "2023"]
    assert set(values(spark, E.year, spelt)) == {"2023"}
    assert values(spark, E.year, ["none"]) == ["none"]


def test_genres(spark):
    assert set(values(spark, E.genres, ["rock,pop,rock-pop,", "rock;pop;rock-pop,", "rock/pop/rock-pop,", "rock, pop, rock-pop, "])) == {"Rock, Pop, Rock-Pop"}
    assert values(spark, E.genres, ["rock,pop/rock-pop;80s,"]) == ["Rock, Pop, Rock-Pop, 80s"]


def test_bpm_and_beats(spark):
    assert values(spark, E.file_bpm, [120.0, 130.0, 0.0, 123.45, 0.001]) == [30, 32.5, 0, 30.8625, 0.00025]
    assert values(spark, E.beat_multiplier, [30.0, 400.0, 500.0]) == [13, 0, 0]
    n = spark.createDataFrame([("s", 0, 0.5, 2.5, 120.0), ("s", 1, 3.0, 4.5, 120.0), ("s", 2, 5.5, 7.5, 120.0)], "song_id string, seq int, start double, end double, bpm double")
    got = S.beat_scan(S.beats(n)).orderBy("seq").select("start_beat", "length").collect()
    assert [tuple(r) for r in got] == [(0, 52), (65, 39), (130, 52)]


def test_file_names_and_clock(spark):
    assert values(spark, E.file_name, ['a?b:c"', "<x>/y|z*", "end. . "[:-1] + "."]) == ["abc", "(x)-y-z-", "end"]
    assert values(spark, E.clock, [3661.5]) == ["1:01:01.500"]


def test_beat_scan_is_the_loop(spark):
    rng = random.Random(1)
    rows, want = [], []
    for song in range(20):
        at = 0
        for i in range(rng.randint(1, 30)):
            r, d = rng.randint(-5, 60), rng.randint(0, 6)
            s = max(r, at)
            at = s + d
            rows.append((song, i, r, d))
            want.append((song, i, s))
    out = S.beat_scan(spark.createDataFrame(rows, "song_id int, seq int, want int, length int"))
    assert sorted((r.song_id, r.seq, r.start_beat) for r in out.collect()) == sorted(want)


def test_merge(spark):
    row = lambda i, w, a, b, end, note, midi: ("s", i, w, float(a), float(b), False, end, note, midi, 15.0)
    rows = [row(0, "la", 0, 1, False, "C4", 60), row(1, "~ ", 1, 2, True, "C4", 60), row(2, "do", 2, 3, False, "C4", 60), row(3, "~re ", 3, 4, True, "C4", 60), row(4, "mi ", 4, 5, True, "E4", 64)]
    t = spark.createDataFrame(rows, "song_id string, seq int, word string, start double, end double, is_hyphen boolean, is_word_end boolean, note string, midi int, bpm double")
    got = [(r.word, r.start, r.end, r.note, r.is_word_end) for r in S.merged_syllables(t).orderBy("seq").collect()]
    assert got == [("la ", 0, 2, "C4", True), ("dore ", 2, 4, "C4", True), ("mi ", 4, 5, "E4", True)]


def test_missing_times(spark):
    w = spark.createDataFrame([(1, 1, None, None), (1, 2, 1.0, 2.0), (1, 3, None, None), (1, 4, None, None)], "song_id int, seq int, start double, end double")
    got = [(round(r.start, 6), round(r.end, 6)) for r in S.filled_times(w).orderBy("seq").collect()]
    assert got == [(0.0, 0.1), (1.0, 2.0), (2.1, 2.2), (2.3, 2.4)]


def test_syllables_without_parts(spark):
    t = spark.createDataFrame([Row(song_id=1, seq=0, word="a", start=0.0, end=1.0, parts=None), Row(song_id=1, seq=1, word="ab", start=1.0, end=2.0, parts=["a", "b"])], "song_id int, seq int, word string, start double, end double, parts array<string>")
    got = [tuple(r) for r in G.syllables(t).orderBy("seq", "piece_no").collect()]
    assert got == [(1, 0, 0, "a", 0.0, 1.0, False, True), (1, 1, 0, "a", 1.0, 1.5, True, False), (1, 1, 1, "b", 1.5, 2.0, True, True)]


def test_indel_ratio(spark):
    df = spark.createDataFrame([("abcd", "abxd"), ("", ""), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(L.indel_ratio(F.col("a"), F.col("b"))).collect()] == [0.75, 1.0, None]


def test_text_round_trip(spark):
    songs = spark.createDataFrame([("s", "1.1.0", "A", "T", "390.0", "500")], "song_id string, version string, artist string, title string, bpm string, gap string")
    notes = spark.createDataFrame([("s", 0, 0, 52, 1, "Alpha ", True, 60), ("s", 1, 65, 39, 2, "is ", False, 0)], "song_id string, seq int, start_beat int, length int, pitch int, word string, line_break boolean, break_beat int")
    text = K.files(K.header_lines(songs).unionByName(K.note_text(notes))).first().content
    assert text == "#VERSION:1.1.0\n#ARTIST:A\n#TITLE:T\n#BPM:390.0\n#GAP:500\n: 0 52 1 Alpha \n- 60\n: 65 39 2 is \nE"
    lines = spark.createDataFrame([("s", i, x) for i, x in enumerate(text.split("\n"))], "song_id string, line_no int, line string")
    got = K.note_lines(lines).orderBy("line_no").select("start_beat", "pitch", "word").collect()
    assert [tuple(r) for r in got] == [(0.0, 1, "Alpha"), (65.0, 2, "is")]
    assert K.headers(lines).first().artist == "A"


def test_clean_of_all_languages(spark, tmp_path):
    texts = [(1, " It's, GOOD! ", "en"), (2, "Über-Maß: Öl?", "de"), (3, "¿Qué TAL? ÑU", "es"), (4, "L'Été (à ÇA)", "fr"), (5, "No. LANG", None), (6, None, "fr"), (7, "...", "de")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {d: t if t is None else hashlib.md5("".join(c for c in t if c not in string.punctuation).lower().strip(" ").encode()).hexdigest() for d, t, _ in texts}
    assert {r.doc_id: r.clean for r in plans.q_clean(spark, str(tmp_path)).collect()} == want


def test_malformed_note_lines(spark):
    lines = spark.createDataFrame([("s", 0, "#BPM:120"), ("s", 1, "#GAP:0"), ("s", 2, ": 4 2 la"), ("s", 3, ": x 2 5 la"), ("s", 4, ":"), ("s", 5, "F 8 1 3 do")], "song_id string, line_no int, line string")
    got = {r.line_no: (r.start_beat, r.pitch, r.word) for r in K.note_lines(lines).collect()}
    assert got == {2: (4.0, None, ""), 3: (None, 5, "la"), 5: (8.0, 3, "do")}
    assert values(spark, E.hz_to_midi, [440.0, 0.0, -1.0]) == [69, None, None]


def test_index_ranges(spark):
    """Frames nearest to the ends: the later one on a tie, the first of those at or after the time, one frame at least."""
    rng = random.Random(2)
    frames, segments, want = [], [], []
    for song in range(12):
        times = sorted(round(rng.uniform(0, 10) * 4) / 4 for _ in range(rng.randint(1, 40)))
        frames += [(song, i, t, 440.0, 1.0) for i, t in enumerate(times)]

        def near(x, times=times):
            i = next((i for i, t in enumerate(times) if t >= x), len(times))
            return i - 1 if i and (i == len(times) or x - times[i - 1] < times[i] - x) else i

        for k in range(20):
            a = rng.choice([rng.uniform(-1, 11), round(rng.uniform(0, 10) * 8) / 8])
            b = a + rng.choice([0.01, 0.125, 2.0])
            segments.append((song, k, a, b))
            want.append((song, k, near(a), max(near(b), near(a) + 1)))
    f = spark.createDataFrame(frames, "song_id int, frame_idx int, t double, freq double, conf double")
    s = spark.createDataFrame(segments, "song_id int, seg int, start double, end double")
    got = [(r.song_id, r.seg, r.first_frame, r.stop_frame) for r in J.index_ranges(s, f).collect()]
    assert sorted(got) == sorted(want)
    counts = J.in_index_range(J.index_ranges(s, f), f.select("song_id", "frame_idx"), 3).groupBy("song_id", "seg").count().collect()
    assert sorted((r.song_id, r.seg, r["count"]) for r in counts) == sorted((a, b, d - c) for a, b, c, d in want)


def test_marked_syllables(spark):
    cases = [("(ab)c", ["a", "bc"], ["(a", "b)c"]), ("a-b!!", ["a", "b"], ["a", "-b!!"]), ("abc", ["abc"], None), ("a" * 101, ["a", "a" * 100], None), ("x--yz", ["x", "yz"], ["x", "-yz-"])]
    df = spark.createDataFrame([(w, s) for w, s, _ in cases], "w string, s array<string>")
    assert [r[0] for r in df.select(E.marked_syllables(F.col("w"), F.col("s"))).collect()] == [x for _, _, x in cases]


def test_version_probe_and_gate(spark):
    df = spark.createDataFrame([(["a", "MuseScore 4", "MuseScore 3"],), (["MuseScore"],), ([],)], "x array<string>")
    assert [r[0] for r in df.select(E.version_in(F.col("x"))).collect()] == [4, -1, -1]
    assert values(spark, lambda v: E.at_least(v, "1.1.0"), ["1.1.0", "1.0.9", "1.x.0"]) == [True, False, False]
    ordered = ["0.9", "1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1", "1.0.0.post1", "1.1.dev3", "1.1.0rc1", "1.1", "v1.1.0", "1.1.0.0", "1.1.post2", "1.2.0rc1", "1.2", "1.10", "2"]
    at = [None, "", "one", "1..1", "1.1.", *ordered]
    assert values(spark, lambda v: E.at_least(v, "1.1.0"), at) == [None, False, False, False, False, *(ordered.index(x) >= ordered.index("1.1") for x in ordered)]
    assert values(spark, lambda v: E.at_least(v, "1.2.0"), ["1.2", "1.2.0rc1", "1.1.9", "1.02"]) == [True, False, False, True]


def test_bpm_text_is_python_rounding(spark):
    rng = random.Random(11)
    x = [2.675, 12345678.125, 12345678.375, 0.285, 1.005, 0.125, 0.375, 99.995, 199.999, 0.0, 0.004, 0.005, 120.0, 1e9 + 0.125, 2.5, 3e12 + 0.1, -2.675, 0.015, 1e-9]
    x += [round(rng.uniform(0, 500), 3) for _ in range(400)] + [rng.uniform(0, 1) for _ in range(200)] + [k / 200 for k in range(1, 400, 2)] + [10 ** rng.uniform(-4, 11) for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double")
    got = {r.i: r.t for r in df.select("i", E.bpm_text(F.col("v")).alias("t")).collect()}
    assert [got[i] for i in range(len(x))] == [str(round(v, 2)) for v in x]


def sung_score(lines, frames, step=0.09):
    """The score as it is defined, note by note: a part's frames are the slice between those nearest to its ends."""
    times = [t for t, _, _ in frames]

    def near(x):
        i = next((i for i, t in enumerate(times) if t >= x), len(times))
        return i - 1 if i and (i == len(times) or x - times[i - 1] < times[i] - x) else i

    out = {}
    for kind in ("accurate", "simple"):
        n = g = parts = full = 0
        for word, tag, pitch, a, b in lines:
            if word == "" or tag == "F":
                continue
            count = int((b - a) / step) or 1
            hits = 0
            for p in range(count):
                s, e = a + step * p, b if p == count - 1 else a + step * p + step
                i, j = near(s), near(e)
                own = frames[i:j] or [frames[i]]
                sure = [f for f in own if f[2] > 0.4] or own
                notes = [round(12 * (math.log2(f / 440)) + 69) for _, f, _ in sure]
                midi = max(notes, key=lambda m: (notes.count(m), -notes.index(m)))
                hits += midi == pitch + 48 if kind == "accurate" else midi % 12 == (pitch + 48) % 12
            n, g, parts, full = n + hits * (tag not in "*G"), g + 2 * hits * (tag in "*G"), parts + count, full + (hits == count)
        bonus = full * (1000 / len(lines))
        top = 9000 if bonus else 10000
        notes = round(top * n / parts)
        out[kind] = (top, notes, g, round(bonus), round(notes + bonus + g))
    return out


def test_score_hears_the_nearest_frames(spark):
    """Frames each 0.2 seconds: every part of 0.09 hears one, so a note sung right earns everything."""
    frames = [(0.2 * k, 440.0, 1.0) for k in range(10)]
    lines = [("la ", ":", 21, 0.0, 0.9), ("lo ", ":", 21, 0.9, 1.8)]
    rng = random.Random(4)
    rough = [(round(0.2 * k + rng.uniform(0, 0.1), 3), rng.choice([440.0, 220.0, 262.0]), rng.random()) for k in range(60)]
    mixed = [(rng.choice(["la ", "~", ""]), rng.choice(":*FRG"), rng.choice([21, 9, 12]), round(0.5 * k, 2), round(0.5 * k + rng.choice([0.05, 0.3, 0.45]), 2)) for k in range(20)]
    songs = {"right": (lines, frames), "rough": (mixed, rough)}
    ln = spark.createDataFrame([(s, i, tag, w, p, a, b) for s, (x, _) in songs.items() for i, (w, tag, p, a, b) in enumerate(x)], "song_id string, line_no int, note_type string, word string, pitch int, start_time double, end_time double")
    fr = spark.createDataFrame([(s, i, t, f, c) for s, (_, x) in songs.items() for i, (t, f, c) in enumerate(x)], "song_id string, frame_idx int, t double, freq double, conf double")
    got = {(r.song_id, r.granularity): (r.max_score, r.notes, r.golden, r.line_bonus, r.score) for r in M.score(ln, fr).collect()}
    assert got == {(s, k): v for s, (x, f) in songs.items() for k, v in sung_score(x, f).items()}
    assert got[("right", "accurate")] == (9000, 9000, 0, 1000, 10000)
    within = {(r.song_id, r.granularity): r.score for r in M.score(ln, fr, 1.0, M.pitch_of).collect()}
    assert within[("right", "accurate")] < 10000


def test_word_search_in_blocks(spark):
    words = spark.createDataFrame([("hose",), ("house",), ("zzz",), (None,)], "word string")
    entries = spark.createDataFrame([("house", 1), ("horse", 0), ("z", 2)], "entry string, ord int")
    for rows in (1, 2, 100):
        got = sorted(map(tuple, L.nearest_word(words, entries, rows).collect()))
        assert got == [("hose", "horse", 1), ("house", "house", 0), ("zzz", "z", 2)]


def test_header_files_deal_out_songs_not_lines(spark):
    """The same files as by lines, also where a song has several rows; a version is read once for all headers, and no line is a row of its own."""
    rows = [(1, "1.2.0", "A", "T", "m.mp3", "v"), (2, "0.2.0", "B", None, None, "w"), (2, "1.1.0", "C", "U", "n.mp3", None), (3, None, "D", "V", "o.mp3", "x"), (4, "none", "E", "W", "p.mp3", "y"), (5, None, None, None, None, None)]
    songs = spark.createDataFrame(rows, "song_id int, version string, artist string, title string, audio string, video_url string")
    got = K.header_files(songs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, K.files(K.header_lines(songs)).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("RLIKE") == 1
