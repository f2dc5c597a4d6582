"""Syllables by patterns and forced alignment against slow models of their definitions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.functions import expr as E
from notewright.operators import alignment as A
from notewright.operators import generators as G
from notewright.operators import hyphenation as H
from notewright.operators import sequences as S
from notewright.plans import songs


def slow_parts(word, patterns, left=2, right=2):
    """The pattern method as it is usually written: a list of digits, one for each place of the dotted word."""
    low = "." + word.lower() + "."
    rate = [0] * (len(low) + 1)
    for p in patterns:
        letters = "".join(c for c in p if not c.isdigit())
        digits, k = [0] * (len(letters) + 1), 0
        for c in p:
            if c.isdigit():
                digits[k] = int(c)
            else:
                k += 1
        for at in range(len(low) - len(letters) + 1):
            if low[at : at + len(letters)] == letters:
                for i, d in enumerate(digits):
                    rate[at + i] = max(rate[at + i], d)
    cuts = [k for k in range(left, len(word) - right + 1) if rate[k + 1] % 2]
    return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]


PATTERNS = [".ach4", "1ba", "a1b", "2b3c", "c4", "1d", ".d2", "3e.", "a1b2c", "b1b", "4aa", "é1", "2ca1"]


def test_syllables_equal_the_slow_method(spark):
    rng = random.Random(1)
    words = {"".join(rng.choice("abcdeé") for _ in range(rng.randint(0, 12))) for _ in range(300)} | {"achab", "d", "Dabba", "ABBA"}
    tokens = spark.createDataFrame([(i, "xx", w) for i, w in enumerate(sorted(words))], "seq int, lang string, word string")
    table = spark.createDataFrame([("xx", p) for p in PATTERNS] + [("yy", "1a"), ("xx", "1ba"), ("xx", ""), ("xx", None), ("xx", "7")], "lang string, pattern string")
    got = {r.word: r.parts for r in H.hyphenated(tokens, table).collect()}
    want = {w: slow_parts(w, PATTERNS) for w in words}
    assert got == {w: p if len(p) > 1 else None for w, p in want.items()}
    assert sum(p is not None for p in got.values()) > 100


def test_syllables_of_odd_words(spark):
    """Marks and case stay, other languages and long words have none, null words too; then the split takes its shares of time."""
    table = spark.createDataFrame([("en", "a1b"), ("en", "b1a")], "lang string, pattern string")
    rows = [(0, "(Ab", "en"), (1, "aaBB-aa!", "en"), (2, "aabb", "de"), (3, "ab" * 51, "en"), (4, None, "en"), (5, "aabb", None), (6, "ab" * 50, "en"), (7, "", "en"), (8, "... ", "en")]
    t = spark.createDataFrame(rows, "seq int, word string, lang string")
    got = {r.seq: r.parts for r in H.hyphenated(t, table).collect()}
    assert got[1] == ["aa", "BB", "-aa!"] and got[6][:2] == ["ab", "a"][:1] + got[6][1:2] and len(got[6]) > 50
    assert [got[k] for k in (0, 2, 3, 4, 5, 7, 8)] == [None] * 7
    timed = H.hyphenated(t, table).filter("seq = 1").withColumns({"song_id": F.lit("s"), "start": F.lit(0.0), "end": F.lit(3.0)})
    assert [(r.word, r.start, r.end) for r in G.syllables(timed).orderBy("piece_no").collect()] == [("aa", 0.0, 1.0), ("BB", 1.0, 2.0), ("-aa!", 2.0, 3.0)]
    assert H.hyphenated(t.limit(0), table).count() == 0
    assert [r.parts for r in H.hyphenated(t, table.limit(0)).collect()] == [None] * 9


def slow_marks(word, syllables):
    """Marks put back letter by letter: one before a letter, two characters of the word further then; what is left goes to the end."""
    gone = [(i, c) for i, c in enumerate(word) if c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ "]
    at, i, out = {i for i, _ in gone}, 0, []
    for s in syllables:
        text = ""
        for c in s:
            if i in at:
                text, i = text + gone.pop(0)[1], i + 1
            text, i = text + c, i + 1
        out.append(text)
    return [*out[:-1], out[-1] + "".join(c for _, c in gone)]


def test_marks_equal_the_slow_method(spark):
    rng, rows = random.Random(4), [("!" * 300 + "ab", ["a", "b"]), ("a." * 100, ["a"] * 100), ("ab\U0001f600--", ["ab", "\U0001f600"]), ("ab!", ["abx", "yz"])]
    for _ in range(400):
        word = "".join(rng.choice("abé.-!( \n") for _ in range(rng.randint(2, 14)))
        own = "".join(c for c in word if c not in ".-!( ")[: rng.choice([99, 99, 3])]
        k = sorted(rng.randint(0, len(own)) for _ in range(rng.randint(1, 3)))
        rows.append((word, [own[a:b] for a, b in zip([0, *k], [*k, len(own)])]))
    df = spark.createDataFrame(rows, "word string, s array<string>").select("word", "s", E.marked_syllables(F.col("word"), F.col("s")).alias("got"))
    assert [(r.word, r.got) for r in df.collect()] == [(w, slow_marks(w, s)) for w, s in rows]


def test_syllables_cut_the_texts_once(spark):
    """Neither are texts read for the words and again for their cuts, nor are substrings shuffled to the small table of patterns."""
    plan = songs.q_syllables(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "FileScan" not in plan and plan.count("ExistingRDD") == 2
    assert plan.count("BroadcastHashJoin [lang") == 1


def slow_paths(blank, own):
    """Every way to put the symbols on frames: for each, the total and the frames of the steps; the best, by the same ties."""
    frames, symbols = own.shape
    best = None
    for steps in itertools.combinations(range(frames), symbols):
        total, k = 0.0, 0
        for t in range(frames):
            if k < symbols and t == steps[k]:
                total, k = total + own[t, k], k + 1
            else:
                total += blank[t]
        if best is None or total > best[0] + 1e-9:
            best = (total, [steps])
        elif abs(total - best[0]) <= 1e-9:
            best[1].append(steps)
    return best


def test_paths_are_the_best_of_all():
    rng = np.random.default_rng(3)
    for _ in range(150):
        frames, symbols = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        blank, own = np.log(rng.random(frames)), np.log(rng.random((frames, symbols)))
        found = A.best_path(blank, own)
        if symbols > frames:
            assert found is None
            continue
        _, ways = slow_paths(blank, own)
        assert tuple(found[0].tolist()) in ways
        steps = found[0].tolist()
        assert found[1].tolist() == [*steps[1:], frames]
        spans = [np.mean([np.exp(own[a, k])] + [np.exp(blank[t]) for t in range(a + 1, b)]) for k, (a, b) in enumerate(zip(steps, found[1].tolist()))]
        assert np.allclose(found[2], spans)


def emissions(song, segment, rows, symbols):
    return [(song, segment, t, s, float(np.log(p))) for t, row in enumerate(rows) for s, p in zip(symbols, row) if p > 0]


@pytest.fixture
def heard(spark):
    """Segment 0 says `ab ca`, in 9 frames of which each has one likely symbol."""
    symbols, said = "-|abc", "a-b|c--a-"
    rows = [[0.9 if s == x else 0.025 for s in symbols] for x in said]
    return spark.createDataFrame(emissions("s", 0, rows, symbols) + emissions("s", 1, rows[:2], symbols), "song_id string, segment int, frame int, symbol string, logp double")


def test_alignment_through_spark(spark, heard):
    words = [("s", 0, 0, "ab", 10.0), ("s", 0, 1, "zz!", 10.0), ("s", 0, 2, "Ca", 10.0), ("s", 1, 0, "abca", 20.0), ("s", 2, 0, "a", 0.0), ("t", 0, 0, None, 0.0)]
    w = spark.createDataFrame(words, "song_id string, segment int, seq int, word string, offset double")
    got = {(r.song_id, r.segment, r.seq): (r.start, r.end) for r in A.aligned(w, heard, 0.5).collect()}
    assert got[("s", 0, 0)] == (10.0, 11.5) and got[("s", 0, 1)] == (None, None) and got[("s", 0, 2)] == (12.0, 14.5)
    assert [got[k] for k in (("s", 1, 0), ("s", 2, 0), ("t", 0, 0))] == [(None, None)] * 3
    filled = S.filled_times(A.aligned(w.filter("segment = 0 and song_id = 's'"), heard, 0.5)).orderBy("seq").collect()
    assert [(round(r.start, 3), round(r.end, 3)) for r in filled] == [(10.0, 11.5), (11.6, 11.7), (12.0, 14.5)]
    assert A.aligned(w.limit(0), heard, 0.5).count() == 0
    assert [r.start for r in A.aligned(w, heard.limit(0), 0.5).collect()] == [None] * 6
