"""The pitch tracker on tones whose frequency is known."""

import itertools

import numpy as np

from notewright.operators import pitch as P
from notewright.sources import media as M
from notewright.sources import wav_blocks as WB


def frames_of(spark, x, rate, block):
    longest, width = P.widths(rate)
    half = (longest + width) // 2 + 1
    songs = spark.createDataFrame([("s", bytearray(M.wav_bytes(x, rate)))], "song_id string, data binary")
    rows = P.tracked(WB.blocks_of(songs, block, half, half)).orderBy("frame_idx").collect()
    return np.array([[r.t, r.freq, r.conf] for r in rows])


def voice(phase):
    """A tone with harmonics, the second louder than the first."""
    return 0.3 * (0.6 * np.sin(phase) + 0.8 * np.sin(2 * phase) + 0.4 * np.sin(3 * phase))


def test_sweeps_over_the_whole_range(spark):
    """From 47 to 2,093 Hz within half a semitone, at any rate and block length."""
    for rate, low, high in ((16000, 47.0, 400.0), (16000, 300.0, 2093.0), (44100, 60.0, 2093.0)):
        t = np.arange(4 * rate) / rate
        hz = low * (high / low) ** (t / 4)
        phase = 2 * np.pi * np.cumsum(hz) / rate
        for x in ((0.5 * np.sin(phase), voice(phase)) if rate == 16000 else (0.5 * np.sin(phase),)):
            got = frames_of(spark, x, rate, 16384)
            assert len(got) == -(-len(x) // (P.HOP * rate)) and np.allclose(got[:, 0], np.arange(len(got)) * P.HOP)
            inner = got[8:-8]
            want = low * (high / low) ** (inner[:, 0] / 4)
            off = np.abs(12 * np.log2(inner[:, 1] / want))
            assert off.max() < 0.5 and (inner[:, 2] > 0.4).all(), (rate, low, off.max(), inner[:, 2].min())


def test_silence_noise_and_blocks(spark):
    rate, rng = 16000, np.random.default_rng(5)
    t = np.arange(rate) / rate
    x = np.concatenate([np.zeros(rate), voice(2 * np.pi * 220 * t), rng.normal(0, 0.1, rate), voice(2 * np.pi * 330 * t)])
    whole = frames_of(spark, x, rate, len(x))
    for block in (5000, 1024):
        assert np.allclose(frames_of(spark, x, rate, block), whole, atol=1e-6)
    second = lambda k: whole[(whole[:, 0] > k + 0.1) & (whole[:, 0] < k + 0.9)]
    assert (second(0)[:, 2] <= 0.3).all() and (second(0)[:, 1] == 0).all()
    assert np.allclose(second(1)[:, 1], 220, rtol=0.01) and np.allclose(second(3)[:, 1], 330, rtol=0.01)
    assert np.median(second(2)[:, 2]) < 0.4 < second(1)[:, 2].min()


def test_the_path_is_the_cheapest_of_all():
    rng = np.random.default_rng(9)
    for _ in range(40):
        hz, cost = 100 * 2 ** rng.uniform(0, 2, (5, P.CANDIDATES)), rng.random((5, P.CANDIDATES))
        hz[rng.random(hz.shape) < 0.2] = np.nan

        def price(path):
            total = 0.0
            for t, k in enumerate(path):
                if k < P.CANDIDATES and np.isnan(hz[t, k]):
                    return np.inf
                total += cost[t, k] if k < P.CANDIDATES else P.UNSUNG
                if t:
                    j = path[t - 1]
                    if (j == P.CANDIDATES) != (k == P.CANDIDATES):
                        total += P.TURN
                    elif k < P.CANDIDATES:
                        total += P.LEAP * abs(np.log2(hz[t - 1, j]) - np.log2(hz[t, k]))
            return total

        best = min(itertools.product(range(P.CANDIDATES + 1), repeat=5), key=price)
        freq, conf = P.best_track(hz, np.where(np.isnan(hz), np.nan, cost))
        for t, k in enumerate(best):
            if k < P.CANDIDATES:
                assert freq[t] == hz[t, k] and conf[t] == 1 - cost[t, k]
            else:
                assert conf[t] <= 0.3
