import io
import struct
import wave

import numpy as np
from pyspark.sql import functions as F

from notewright.functions import text as X
from notewright.sources import media as M
from notewright.streaming import frames as FS


def wav(x, rate=1000):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.asarray(x) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_silences_and_injected_model(spark):
    x = np.concatenate([np.full(100, 0.5), np.zeros(200), np.full(100, 0.5)])
    songs = spark.createDataFrame([("s", bytearray(wav(x)))], "song_id string, data binary")
    assert [(r.start, r.end) for r in M.silences(songs).collect()] == [(0.1, 0.3)]
    frames = M.pitch_frames(songs, lambda: lambda x, rate: (np.arange(3.0), np.full(3, 440.0), np.ones(3)))
    assert [r.t for r in frames.collect()] == [0.0, 1.0, 2.0]


def test_midi_bytes(spark):
    notes = spark.createDataFrame([("s", 60, 0.0, 1.0, "la ")], "song_id string, midi int, start double, end double, word string")
    data = bytes(M.midi_files(notes, 120.0).first().data)
    assert data[:4] == b"MThd" and b"la " in data and b"\x90\x3c\x64" in data and data.endswith(b"\xff\x2f\x00")


def test_number_words_of_french_and_large_numbers():
    words = {0: "zéro", 16: "seize", 21: "vingt et un", 60: "soixante", 61: "soixante et un", 70: "soixante-dix", 71: "soixante et onze", 77: "soixante-dix-sept", 80: "quatre-vingts", 81: "quatre-vingt-un", 90: "quatre-vingt-dix", 91: "quatre-vingt-onze", 99: "quatre-vingt-dix-neuf"}
    words |= {100: "cent", 101: "cent un", 200: "deux cents", 201: "deux cent un", 1000: "mille", 1980: "mille neuf cent quatre-vingts", 3003: "trois mille trois", 80000: "quatre-vingt mille", 200000: "deux cent mille", 10**6: "un million", 2 * 10**8: "deux cents millions", 10**9 + 1: "un milliard un"}
    assert {n: X.spelled(str(n), "fr") for n in words} == words
    big = 2 * 10**15 + 10**12 + 3 * 10**9 + 7
    assert X.spelled(f"a {big}", "fr") == "a deux billiards un billion trois milliards sept"
    assert X.spelled(f"a {big}", "de") == "a zwei Billiarden eine Billion drei Milliarden sieben"
    assert X.spelled(f"a {big}", "en") == "a two quadrillion, one trillion, three billion and seven"
    assert X.spelled(f"a {2 * 10**12 + 3 * 10**9 + 7}", "es") == "a dos billones tres mil millones siete"
    assert X.spelled(f"a {big}", "xx") == "a "
    assert X.spelled("9" * 33, "en").startswith("nine hundred and ninety-nine nonillion, ") and X.spelled("9" * 34, "en") == "9" * 34
    assert X.spelled("9" * 5000, "fr") == "9" * 5000


def test_number_words():
    assert X.spelled("I have 1 million dollars and 2 cents.", "en") == "I have one million dollars and two cents."
    assert X.spelled("Hello world 1, 2!. 3. 4? Test 100#", "en") == "Hello world one, two!. three. four? Test one hundred#"
    assert X.spelled("Ich habe 1 Million Dollar und 2 Cent.", "de") == "Ich habe eins Million Dollar und zwei Cent."
    assert X.spelled("Hallo Welt 1, 2!. 3. 4? Test 100#", "de") == "Hallo Welt eins, zwei!. drei. vier? Test einhundert#"
    assert X.spelled("Hola mundo 1, 2!. 3. 4? Prueba 100#", "es") == "Hola mundo uno, dos!. tres. cuatro? Prueba cien#"
    assert X.spelled("a 1", "xx") == "a "


def test_text_udfs(spark):
    df = spark.createDataFrame([("é 2", "de"), (None, "en")], "x string, g string")
    assert [tuple(r) for r in df.select(X.number_words("x", "g"), X.ascii_folded("x")).collect()] == [("é zwei", "e 2"), (None, None)]


def test_language_region(spark):
    asked = spark.createDataFrame([("en",), ("de",), ("fr",), ("zz",)], "language string")
    installed = spark.createDataFrame([("de", 1), ("de_DE", 2), ("en", 3), ("en_US", 4), ("en_GB", 5)], "code string, ord int")
    offered = spark.createDataFrame([("fr_CA", 1), ("fr_FR", 2)], "code string, ord int")
    got = dict(map(tuple, X.language_region(asked, installed, offered).collect()))
    assert got == {"en": "en_US", "de": "de_DE", "fr": "fr_FR", "zz": None}


def test_streamed_windows(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0, 440.0, 0.9), ("s", 1, 440.0, 0.9), ("s", 100, 220.0, 0.9)], "song_id string, k long, freq double, conf double").withColumn("ts", F.timestamp_seconds("k")).drop("k")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, out in (("grid", FS.grid_notes(stream, "10 seconds", "1 minute")), ("spans", FS.sung_spans(stream, "5 seconds", "1 minute"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert sorted(r.n for r in spark.table(name).collect()) == [1, 2]


def test_other_wav_formats():
    x = np.array([0.0, 0.5, -0.5, 0.25])

    def riff(kind, bits, raw, channels=1):
        fmt = struct.pack("<HHIIHH", kind, channels, 1000, 1000 * channels * bits // 8, channels * bits // 8, bits)
        body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(raw)) + raw
        return b"RIFF" + struct.pack("<I", len(body)) + body

    for data in (riff(3, 32, x.astype("<f4").tobytes()), riff(3, 64, x.astype("<f8").tobytes()), riff(1, 32, (x * 2**31).astype("<i4").tobytes()), riff(1, 24, b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in x)), riff(1, 8, (x * 128 + 128).astype(np.uint8).tobytes())):
        got, rate = M.samples(data)
        assert rate == 1000 and np.allclose(got, x, atol=1e-6)
    assert np.allclose(M.samples(riff(1, 16, np.array([[16384, -16384], [16384, 16384]], "<i2").tobytes(), 2))[0], [0, 0.5])


def test_chroma_and_tempo(spark):
    rate = 8000
    t = np.arange(10 * rate) / rate
    chord = sum(np.sin(2 * np.pi * 440 * 2 ** ((m - 69) / 12) * t) for m in (60, 64, 67, 72))
    clicks = np.zeros(12 * rate)
    for k in range(24):
        clicks[k * rate // 2 : k * rate // 2 + 200] = np.sin(np.arange(200))
    songs = spark.createDataFrame([("chord", bytearray(wav(chord / 4, rate))), ("clicks", bytearray(wav(clicks, rate))), ("none", bytearray(wav(np.zeros(10), rate)))], "song_id string, data binary")
    weights = {(r.song_id, r.pc): r.weight for r in M.chroma_weights(songs).collect()}
    assert abs(sum(weights["chord", pc] for pc in range(12)) - 1) < 1e-9 and sum(weights["chord", pc] for pc in (0, 4, 7)) > 0.8
    bpm = {r.song_id: r.bpm for r in M.tempos(songs).collect()}
    assert abs(bpm["clicks"] - 120) < 2 and bpm["none"] == 0
    assert sum(weights["none", pc] for pc in range(12)) == 0


def test_chunks_and_muting(spark):
    x = np.full(1000, 0.5)
    songs = spark.createDataFrame([("s", bytearray(wav(x))), ("q", bytearray(wav(x)))], "song_id string, data binary")
    spans = spark.createDataFrame([("s", 0.1, 0.3)], "song_id string, start double, end double")
    got = {r.song_id: M.samples(bytes(r.data))[0] for r in M.muted_files(songs, spans).collect()}
    assert (got["s"][100:300] == 0).all() and got["s"][99] > 0 and got["s"][300] > 0 and (got["q"] > 0).all()
    manifest = spark.createDataFrame([("s", "a.wav", 10, 30)], "song_id string, file string, first_frame long, last_frame long")
    chunk = M.chunk_files(songs, manifest).first()
    assert chunk.file == "a.wav" and len(M.samples(bytes(chunk.data))[0]) == 20


def test_folding():
    assert [X.folded(t) for t in ("Straße", "Øre æ Łódź", "naïve “x”", "日本")] == ["Strasse", "Ore ae Lodz", 'naive "x"', ""]
