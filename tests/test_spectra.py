"""Audio blocks against whole files: splits, formats, spectrograms, chroma, noise."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.operators import music as MU
from notewright.operators import spectra as SP
from notewright.sources import media as M
from notewright.sources import wav_blocks as WB


def wav(raw, kind, channels, bits, rate, extra=b"", size=None):
    fmt = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + extra + b"data" + struct.pack("<I", len(raw) if size is None else size) + raw
    return b"RIFF" + struct.pack("<I", len(body)) + body


def formats():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, 2 * 5001)
    wide = (x * (2**31 - 1)).astype("<i4")
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    return {
        "u8": wav(((x + 1) * 127).astype(np.uint8).tobytes(), 1, 2, 8, 8000), "i16": wav((x * 32767).astype("<i2").tobytes(), 1, 1, 16, 44100, odd), "i24": wav(wide.view(np.uint8).reshape(-1, 4)[:, 1:].tobytes(), 1, 2, 24, 48000),
        "i32": wav(wide.tobytes(), 1, 1, 32, 16000), "f32": wav(x.astype("<f4").tobytes(), 3, 2, 32, 22050), "f64": wav(x.astype("<f8").tobytes(), 3, 1, 64, 22050), "short": wav(b"", 1, 1, 16, 8000),
    }


@pytest.fixture
def reader(spark):
    spark.dataSource.register(WB.WavBlocks)

    def read(path, **options):
        return spark.read.format("wav_blocks").options(**options).load(str(path))

    return read


def test_any_split_gives_the_same_samples(reader, tmp_path):
    for name, data in formats().items():
        (tmp_path / f"{name}.wav").write_bytes(data)
        want, rate = M.samples(data)
        for split in (len(data), len(data) // 8 + 1, 1000):
            df = reader(tmp_path / f"{name}.wav", block=700, splitBytes=split)
            assert df.rdd.getNumPartitions() == max(1, -(-len(data) // split))
            rows = df.collect()
            assert np.array_equal(WB.samples_of(df), want) and {r["rate"] for r in rows} <= {rate} and [r["first"] for r in sorted(rows, key=lambda r: r["first"])] == list(range(0, len(want), 700))
            assert {r["total"] for r in rows} <= {len(want)}


def test_folders_neighbours_and_broken_files(spark, reader, tmp_path):
    """A row may have some of its neighbours' samples; what is no WAV file gives no rows; sizes that the header lacks or that were cut off."""
    (tmp_path / "in").mkdir()
    x = (np.arange(5000) % 3000 - 1500).astype("<i2")
    (tmp_path / "in" / "a.wav").write_bytes(wav(x.tobytes(), 1, 1, 16, 8000))
    (tmp_path / "b.WAV").write_bytes(wav(x.tobytes(), 1, 1, 16, 8000, size=0))
    (tmp_path / "c.wav").write_bytes(wav(x.tobytes(), 1, 1, 16, 8000)[:-2001])
    (tmp_path / "d.wav").write_bytes(b"RIFFxxxxWAVEjunk")
    (tmp_path / "e.wav").write_bytes(b"")
    (tmp_path / "f.txt").write_bytes(b"no song")
    df = reader(tmp_path, block=512, before=100, after=60)
    totals = {r.song_id.rpartition("/")[2]: r.total for r in df.select("song_id", "total").distinct().collect()}
    assert totals == {"a.wav": 5000, "b.WAV": 5000, "c.wav": 3999}
    own = df.filter(F.endswith("song_id", F.lit("a.wav")))
    assert np.array_equal(WB.samples_of(own), x.astype(np.float32) / 32768)
    for r in own.collect():
        low, high = max(0, r["first"] - 100), min(5000, r["first"] + 512 + 60)
        assert r["lead"] == r["first"] - low and np.array_equal(np.array(r["samples"], np.float32), x[low:high].astype(np.float32) / 32768)
    songs = spark.createDataFrame([(str(tmp_path / "in" / "a.wav"), bytearray((tmp_path / "in" / "a.wav").read_bytes())), ("none", None)], "song_id string, data binary")
    same = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert same(WB.blocks_of(songs, 512, 100, 60)) == same(own)
    with pytest.raises(Exception, match="nowhere"):
        reader(tmp_path / "nowhere").count()


def test_spectrogram_equals_the_whole_files(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.2, 9001).astype(np.float32)
    x[3000:4000] = 0
    songs = spark.createDataFrame([("s", bytearray(wav(x.astype("<f4").tobytes(), 3, 1, 32, 8000))), ("t", bytearray(wav(x[:200].astype("<f4").tobytes(), 3, 1, 32, 8000)))], "song_id string, data binary")
    w = np.hanning(256)
    want = []
    for at in range(0, len(x) - 256 + 1, 128):
        p = np.abs(np.fft.rfft(x[at : at + 256].astype(np.float64) * w)) ** 2 / (8000 * (w**2).sum())
        p[1:-1] *= 2
        want.append(p)
    for block in (9001, 1000, 300):
        rows = SP.spectrogram(WB.blocks_of(songs, block, 0, 255)).collect()
        got = {(r["column"], r["bin"]): r["db"] for r in rows}
        assert {r["song_id"] for r in rows} == {"s"} and set(got) == {(c, k) for c in range(len(want)) for k in range(129)}
        assert all((got[c, k] is None) == (want[c][k] == 0) and (want[c][k] < 1e-20 or abs(got[c, k] - 10 * np.log10(want[c][k])) < 1e-6) for c in range(len(want)) for k in range(129))
    t = {r["column"]: r["t"] for r in SP.spectra(WB.blocks_of(songs, 1000, 0, 255)).collect()}
    assert t[3] == (3 * 128 + 128) / 8000
    with pytest.raises(Exception, match="more before or after"):
        SP.spectra(WB.blocks_of(songs, 300)).collect()


def tone(hz, seconds, rate):
    t = np.arange(int(seconds * rate)) / rate
    return 0.5 * np.sin(2 * np.pi * hz * t)


def test_pure_tones_land_in_their_class():
    for rate in (16000, 22050, 44100):
        size = 2 * SP.reach(rate)
        for midi in range(24, 108):
            hz = 440 * 2 ** ((midi - 69) / 12)
            if hz < 0.45 * rate:
                c = SP.chroma_frames(tone(hz, size / rate + 0.1, rate)[None, :size], rate)[0]
                assert c.argmax() == midi % 12 and c[midi % 12] == 1 and np.sort(c)[-2] < 0.6, (rate, midi, c.round(2))


def test_chroma_of_songs_in_blocks(spark):
    """Shares add up to one, only the first minute counts, blocks do not matter; a key comes out."""
    rate = 8000
    scale = [60, 62, 64, 65, 67, 69, 71, 72, 60, 64, 67]
    x = np.concatenate([tone(440 * 2 ** ((m - 69) / 12), 0.5, rate) for m in scale])
    long = np.concatenate([tone(440.0, 60, rate), tone(466.16, 30, rate)])
    data = [(s, bytearray(wav((y * 32767).astype("<i2").tobytes(), 1, 1, 16, rate))) for s, y in (("c", x), ("a", long), ("none", np.zeros(rate)))]
    songs = spark.createDataFrame(data, "song_id string, data binary")
    n, found = SP.reach(rate), []
    for block in (1 << 20, 10_000):
        rows = SP.chroma_weights(WB.blocks_of(songs, block, n, n), hop=1024).collect()
        got = {(r.song_id, r.pc): r.weight for r in rows}
        assert all(abs(sum(got[s, k] for k in range(12)) - 1) < 1e-9 for s in "ca") and sum(got["none", k] for k in range(12)) == 0
        found.append(got)
    assert all(abs(found[0][k] - found[1][k]) < 1e-9 for k in found[0])
    assert found[0]["a", 9] > 0.8 and found[0]["a", 10] < 0.02
    key = MU.key_of(SP.chroma_weights(WB.blocks_of(songs.filter("song_id = 'c'"), 10_000, n, n), hop=1024)).first()
    assert (key["key"], key["mode"]) == ("C", "major")


def test_denoise(spark):
    """Noise goes down by what is asked for, a tone stays, blocks do not matter."""
    rng, rate = np.random.default_rng(7), 8000
    noise = rng.normal(0, 0.01, 6 * rate)
    x = noise.copy()
    x[2 * rate : 4 * rate] += tone(1000.0, 2, rate)
    songs = spark.createDataFrame([("s", bytearray(wav(x.astype("<f4").tobytes(), 3, 1, 32, rate)))], "song_id string, data binary")
    out = [WB.samples_of(SP.denoised(WB.blocks_of(songs, block, 1024, 1024), 20.0)) for block in (6 * rate, 5000, 3000)]
    assert all(len(y) == len(x) and np.abs(y - out[0]).max() < 1e-6 for y in out)
    power = lambda y: float(np.mean(y.astype(np.float64) ** 2))
    quiet = slice(rate // 2, 3 * rate // 2)
    assert 17 < 10 * np.log10(power(noise[quiet]) / power(out[0][quiet])) < 20.5
    sung = slice(5 * rate // 2, 7 * rate // 2)
    t = np.arange(rate) / rate
    level = lambda y: abs(np.mean(y[sung] * np.exp(-2j * np.pi * 1000 * t)))
    assert abs(level(out[0]) / level(x) - 1) < 0.02
    same = WB.samples_of(SP.denoised(WB.blocks_of(songs, 5000, 1024, 1024), 0.0))
    assert np.abs(same - x.astype(np.float32)).max() < 1e-5


def test_silences_and_muting_over_blocks(spark):
    """The spans of the whole file, however it is cut; muted samples are zeros, the others stay."""
    rng, rate = np.random.default_rng(11), 8000
    x = rng.normal(0, 0.2, 5 * rate)
    for a, b in ((0.0, 0.3), (1.0, 1.049), (1.5, 1.6), (2.2, 3.9), (4.96, 5.0)):
        x[int(a * rate) : int(b * rate)] = 0
    songs = spark.createDataFrame([("s", bytearray(M.wav_bytes(x, rate))), ("t", bytearray(M.wav_bytes(np.zeros(2 * rate), rate))), ("u", bytearray(M.wav_bytes(x[:100], rate)))], "song_id string, data binary")
    want = sorted((r.song_id, r.sil_idx, r.start, r.end) for r in M.silences(songs).collect())
    assert {s for s, *_ in want} == {"s", "t"} and len(want) >= 4
    for block in (5 * rate, 3000, 1001):
        assert sorted((r.song_id, r.sil_idx, r.start, r.end) for r in SP.silences(WB.blocks_of(songs, block, 0, 400)).collect()) == want
    spans = [(0.5, 0.6), (0.55, 0.7), (3.0, 4.2), (4.9, 99.0), (1.0, 1.0)]
    given = spark.createDataFrame([("s", a, b) for a, b in spans] + [("none", 0.0, 1.0)], "song_id string, start double, end double")
    whole = M.samples(M.wav_bytes(x, rate))[0]
    quiet = M.muted(whole, rate, spans)
    for block in (3000, 777):
        out = SP.muted(WB.blocks_of(songs, block, 100, 50), given)
        assert out.columns == WB.blocks_of(songs).columns and np.array_equal(WB.samples_of(out.filter("song_id = 's'")), quiet)
        assert np.array_equal(WB.samples_of(out.filter("song_id = 'u'")), whole[:100])
        for r in out.filter("song_id = 's'").collect():
            low = r["first"] - r["lead"]
            assert np.array_equal(np.array(r["samples"], np.float32), quiet[low : low + len(r["samples"])])
