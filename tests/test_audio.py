import struct
from math import gcd

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions import audio as signals
from loomtext.sources import annotations, audio


@pytest.mark.parametrize("kind", audio.KINDS)
def test_wav_round_trip(kind):
    frames = np.random.default_rng(1).uniform(-1, 1, (101, 2))
    rate, got = audio.parse_wav(audio.wav_bytes(frames, 22_050, kind) + b"\n")
    assert rate == 22_050 and got.shape == (101, 2)
    assert np.abs(frames - got).max() <= {"pcm8": 0.012, "pcm16": 5e-5, "pcm24": 2e-7, "pcm32": 1e-9, "float32": 5e-8, "float64": 0}[kind]


def test_odd_files():
    good = audio.wav_bytes(np.array([0.5, -0.5]), 8000)
    for bad in (b"", b"RIFF", good[:20], good[:36], b"junk" + good[4:], good.replace(b"data", b"dada"), good[:20] + struct.pack("<H", 7) + good[22:]):
        with pytest.raises(ValueError):
            audio.parse_wav(bad)
    # other chunks, the extensible format, a data chunk that is longer than the file or cut within a frame
    extra = good[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + good[12:]
    assert audio.parse_wav(extra)[1].ravel().tolist() == audio.parse_wav(good)[1].ravel().tolist()
    head = struct.pack("<HHIIHH", 0xFFFE, 1, 8000, 16_000, 2, 16) + struct.pack("<HHI", 22, 16, 4) + struct.pack("<H", 1) + b"\0" * 14
    wide = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", 0xFFFFFFFF) + struct.pack("<hh", 16384, -16384) + b"x"
    assert audio.parse_wav(wide)[1].ravel().tolist() == [0.5, -0.5]
    assert audio.parse_wav(audio.wav_bytes(np.zeros(0), 8000))[1].shape == (0, 1)


def test_files_that_cannot_be_read(spark, tmp_path):
    for name, data in (("a.wav", audio.wav_bytes(np.array([0.25]), 8000)), ("b.wav", b"broken"), ("sub/c.wav", audio.wav_bytes(np.array([[0.5, 0.1]]), 16_000))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    read = audio.read_audio(spark, str(tmp_path))
    assert {r["path"]: (r["rate"], r["channels"]) for r in read.collect()} == {"a.wav": (8000, 1), "b.wav": (None, None), "sub/c.wav": (16_000, 2)}
    items = spark.createDataFrame([(0, "a.wav"), (1, "b.wav"), (2, "sub/c.wav"), (3, "none.wav")], "position int, path string")
    got = {r["position"]: (r["rate"], [round(x, 3) for x in r["samples"]]) for r in annotations.with_audio(items, read.select("path", "rate", "samples")).collect()}
    assert got == {0: (8000, [0.25]), 1: (8000, [0.25]), 2: (16_000, [0.5]), 3: (8000, [0.25])}
    with pytest.raises(Exception, match="neither"):
        annotations.with_audio(items.withColumn("position", 3 - F.col("position")), read.select("path", "rate", "samples")).collect()


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 1), (2, 3), (160, 441), (16_000, 22_050), (3, 3)])
def test_resampling_sums_its_taps(up, down):
    x = np.random.default_rng(1).normal(size=200)
    g = gcd(up, down)
    u, d = up // g, down // g
    h = signals.taps(u, d)
    half = len(h) // 2
    want = x if u == d else [sum(x[k] * h[m * d - k * u + half] for k in range(len(x)) if 0 <= m * d - k * u + half < len(h)) for m in range(-(-len(x) * u // d))]
    assert np.allclose(signals.resample(x, up, down), want, atol=1e-12)


def test_a_tone_keeps_its_pitch(spark):
    tone = lambda rate: np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
    got = signals.resample(tone(44_100), 16_000, 44_100)
    assert len(got) == 16_000 and np.abs(got - tone(16_000))[200:-200].max() < 1e-4
    d = spark.createDataFrame([(0, tone(8000).tolist(), 8000), (1, None, 8000), (2, [], 8000), (3, [0.5], 16_000)], "k int, s array<double>, rate int")
    rows = {r["k"]: r["y"] for r in d.select("k", signals.resampled(F.col("s"), F.col("rate")).alias("y")).collect()}
    assert len(rows[0]) == 16_000 and rows[1] is None and rows[2] == [] and rows[3] == [0.5]
    shown = d.select("k", signals.spectrogram(F.col("s")).alias("m")).select("k", "m.*", F.size("m.values").alias("n")).collect()
    assert {r["k"]: (r["mels"], r["frames"], r["n"]) for r in shown} == {0: (80, 3000, 240_000), 1: (None, None, None), 2: (80, 3000, 240_000), 3: (80, 3000, 240_000)}


def test_spectrogram_by_sums():
    x = np.random.default_rng(2).normal(size=50)
    filters = signals.mel_filters(8000, 16, 6)
    got = signals.log_mel(x, filters, 16, 4)
    want = np.zeros((6, 12))
    for f in range(12):
        power = np.zeros(9)
        for k in range(9):
            total = 0j
            for t in range(16):
                at = f * 4 + t - 8
                at = -at if at < 0 else 2 * 50 - 2 - at if at >= 50 else at
                total += x[at] * (0.5 - 0.5 * np.cos(2 * np.pi * t / 16)) * np.exp(-2j * np.pi * k * t / 16)
            power[k] = abs(total) ** 2
        want[:, f] = np.log10(np.maximum(filters @ power, 1e-10))
    assert np.allclose(got, (np.maximum(want, want.max() - 8) + 4) / 4)
    edges = signals.mel_to_hertz(signals.hertz_to_mel([0, 500, 1000, 4000]))
    assert np.allclose(edges, [0, 500, 1000, 4000])


def test_files_are_made_in_the_memory_of_their_samples(spark):
    import tracemalloc

    import pyarrow as pa

    clips = [np.random.default_rng(k).uniform(-1, 1, (4096, 1)) for k in range(40)]
    frames = pa.array([c.tolist() for c in clips], pa.list_(pa.list_(pa.float64())))
    tracemalloc.start()
    made = sum(len(f) for f in audio._wavs(frames, pa.array(["pcm16"] * 40), 8000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == 40 * (44 + 2 * 4096) and peak < frames.nbytes / 3
    d = spark.createDataFrame([(0, [[0.5], [-0.5]], "pcm16"), (1, None, "pcm8"), (2, [], "pcm24"), (3, [[0.1, 0.2]], "float64")], "k int, f array<array<double>>, kind string")
    got = {r["k"]: r["w"] for r in d.select("k", audio.as_wav(F.col("f"), F.col("kind"), 8000).alias("w")).collect()}
    want = {0: (np.array([0.5, -0.5]), "pcm16"), 2: (np.zeros(0), "pcm24"), 3: (np.array([[0.1, 0.2]]), "float64")}
    assert got == {1: None} | {k: audio.wav_bytes(x, 8000, kind) for k, (x, kind) in want.items()}
