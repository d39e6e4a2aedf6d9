import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import augment, signal, spectral


def test_normalize_and_pcm(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0, 3.0]), (2, [0.0, 0.0]), (3, []), (4, None)], "id int, x array<double>")
    got = {r.id: r.y for r in df.select("id", signal.normalize_clip(F.col("x")).alias("y")).collect()}
    assert got[1] == pytest.approx([0.0, -1.0, 1.0]) and got[2] == [0.0, 0.0] and got[3] == [] and got[4] is None
    pcm = spark.createDataFrame([([2.0, -2.0, 0.99999, -0.00002],)], "x array<double>").select(signal.float_to_pcm(F.col("x")).alias("p"))
    assert pcm.first().p == [32767, -32768, 32767, 0]
    assert pcm.select(signal.pcm_to_float(F.col("p")).alias("x")).first().x == pytest.approx([32767 / 32768, -1.0, 32767 / 32768, 0.0])


def response(sos, f, fs):
    z = np.exp(-2j * np.pi * f / fs)
    return np.prod([(s[0] + s[1] * z + s[2] * z * z) / (1 + s[4] * z + s[5] * z * z) for s in sos])


@pytest.mark.parametrize(("kind", "edges", "passed", "stopped"), [("lowpass", 10.0, 1.0, 40.0), ("highpass", 20.0, 45.0, 2.0), ("bandpass", (10.0, 20.0), 14.5, 45.0), ("bandstop", (10.0, 20.0), 1.0, 14.4)])
def test_butterworth_responses(kind, edges, passed, stopped):
    for order in (2, 3, 5):
        sos = signal.butterworth(order, edges, kind, 100.0)
        assert abs(response(sos, passed, 100.0)) == pytest.approx(1, abs=0.02)
        assert abs(response(sos, stopped, 100.0)) < 0.2
        for edge in np.atleast_1d(edges):
            assert abs(response(sos, edge, 100.0)) == pytest.approx(2**-0.5, abs=1e-6)


def test_zero_phase_keeps_a_passed_tone_in_place():
    t = np.arange(400) / 100
    x = np.sin(2 * np.pi * 5 * t)[None]
    y = signal.zero_phase(signal.butterworth(4, 20.0, "lowpass", 100.0), x)
    assert np.abs(y - x)[:, 30:-30].max() < 1e-3
    assert signal.zero_phase(signal.butterworth(2, 20.0, "lowpass", 100.0), np.ones((2, 50))) == pytest.approx(np.ones((2, 50)))


def test_resample_length_and_tone():
    t = np.arange(800) / 100
    y = signal.resample(np.sin(2 * np.pi * 3 * t), 100, 80)
    assert len(y) == 640
    assert np.abs(y - np.sin(2 * np.pi * 3 * np.arange(640) / 80))[80:-80].max() < 1e-3


def test_spectrogram_shape_and_energy():
    s = spectral.SpectralSettings(1000, 0.128, 0.75, band=(46, 391), kind="spec")
    x = np.random.default_rng(0).normal(size=(2, 2000))
    assert spectral.represent(x, s).shape == (2, 45, 59)
    whole = spectral.SpectralSettings(1000, 0.128, 0.75, kind="spec")
    p = spectral.power_density(x, whole)
    assert p.sum(1).mean() * 1000 / 128 == pytest.approx(1, rel=0.2)
    tone = np.sin(2 * np.pi * 125 * np.arange(2000) / 1000)[None]
    assert (spectral.power_density(tone, whole)[0].argmax(0) == 16).all()


def test_decibels_mel_pcen():
    assert spectral.decibels(np.array([0.0, 1.0 - 1e-10]), full_scale=True) == pytest.approx([0, 1])
    f = np.fft.rfftfreq(256, 1 / 1000)
    bank = spectral.mel_bank(8, (0, 500), f)
    assert bank.sum(0) == pytest.approx(np.ones(8)) and (bank >= 0).all()
    assert spectral.mel_bank_snapped(8, (0, 500), 256, 1000).shape == (129, 8)
    e = np.random.default_rng(1).random((3, 6))
    level, want = np.zeros(3), []
    for t in range(6):
        level = 0.975 * level + 0.025 * e[:, t]
        want.append((e[:, t] / (1e-6 + level) ** 0.98 + 2) ** 0.5 - 2**0.5)
    assert spectral.pcen(e) == pytest.approx(np.array(want).T)


def test_blur_log_palette_resize():
    x = np.random.default_rng(2).random((9, 7))
    k = spectral.gauss_kernel(1.0)
    n = len(k) // 2
    padded = np.pad(x, ((n, n), (0, 0)), mode="symmetric")
    want = np.array([[sum(k[i] * padded[r + i, c] for i in range(len(k))) for c in range(7)] for r in range(9)])
    assert spectral.gaussian_blur(x, 1.0) == pytest.approx(want)
    kernel, factor = spectral.log_kernel(2.0)
    assert factor > 0 and kernel.argmax() == len(kernel) // 2 and spectral.log_filter(x, (1.0, 0.5)).shape == (2, 9, 7)
    idx = spectral.palette_index(x, 5)
    assert idx.min() == 0 and idx.max() == 4 and (spectral.palette_index(np.ones((2, 2)), 5) == 0).all()
    assert spectral.resize(x, 9, 7) == pytest.approx(x) and spectral.resize(x, 18, 3).shape == (18, 3)
    assert spectral.to_image(x, np.eye(3), size=(4, 4)).shape == (4, 4, 3)


def test_augmentations(spark):
    x = [float(v) for v in np.random.default_rng(3).normal(size=16)]
    df = spark.createDataFrame([(1, x), (2, None)], "id long, x array<double>")
    ramp = df.select(augment.ramp_volume(F.col("x"), F.lit(-6.0))).first()[0]
    assert ramp == pytest.approx(np.array(x) * np.linspace(1, 10**-0.3, 16))
    echo = df.select(augment.add_echo(F.col("x"), F.lit(0.25), F.lit(-12.0), 16)).first()[0]
    late = np.r_[np.zeros(4), x[:-4]]
    assert echo == pytest.approx(np.array(x) + 10**-0.6 * np.abs(x).max() * late)
    noise = df.select(augment.gaussian_noise(-20, 1)("id", "x").alias("y"))
    assert noise.collect() == df.repartition(3).select(augment.gaussian_noise(-20, 1)("id", "x").alias("y")).orderBy(F.col("y").isNull()).collect()
    for f in (0.8, 1.0, 1.3):
        y = df.select(augment.shift_pitch(f)("x").alias("y")).collect()
        assert len(y[0].y) == 16 and y[1].y is None
    s = np.arange(20.0).reshape(4, 5)
    for by in (-2, 0, 2):
        for axis in (0, 1):
            assert augment.smear(s, by, axis).shape == augment.squish(s, by, axis).shape == s.shape
    assert augment.smear(s, 0, 0) is s
    first = df.select(augment.chain(F.col("x"), F.col("id"), 1, [(1.0, lambda c, u: augment.ramp_volume(c, u * 6))]).alias("y")).first().y
    assert first != x and len(first) == 16
