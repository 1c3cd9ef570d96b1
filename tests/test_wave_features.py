"""Detectors and features on signals whose answer is known, and kernels against plain formulas."""

import numpy as np
import pytest

from pulsegrid.functions import dsp
from pulsegrid.operators import cardiac, neuro, spectral, wave_features as op


def frame(spark, *signals):
    return spark.createDataFrame([(i, [float(v) for v in s]) for i, s in enumerate(signals)], "record long, values array<double>")


def pulses(rate, seconds, bpm, breath=0.0, depth=0.0):
    t = np.arange(int(rate * seconds)) / rate
    beat = ((1 + np.cos(2 * np.pi * t * bpm / 60)) / 2) ** 2
    return beat * (1 + depth * np.sin(2 * np.pi * breath * t / 60)) + depth * np.sin(2 * np.pi * breath * t / 60)


@pytest.mark.parametrize("bpm", [50, 75, 120])
def test_multiscale_peaks_find_each_pulse_once(spark, bpm):
    r = op.pulse_votes(frame(spark, pulses(50, 30, bpm)), 50.0).first()
    assert abs(r.rate_bpm - bpm) < 2 and abs(r.peaks - bpm / 2) <= 2 and r.long_gaps == 0


def test_breathing_in_a_pulse_wave(spark):
    for breath in (10.0, 15.0, 22.0):
        r = op.pulse_respiration(frame(spark, pulses(25, 90, 75, breath, 0.3)), 25.0).first()
        assert abs(r.rate_bpm - breath) < 2


def test_choice_of_breathing_rates():
    assert op.choose_breathing({}) [1] == "none"
    assert op.choose_breathing({"baseline": [(15.0, 3.0)], "envelope": [(20.0, 9.0)]})[:2] == (15.0, "baseline")
    assert op.choose_breathing({"baseline": [(15.0, 1.0)], "envelope": [(20.0, 9.0)]})[:2] == (20.0, "envelope")
    raised = {"baseline": [(8.4, 4.0), (16.9, 3.0)], "envelope": [(16.9, 3.0)], "amplitude": [(16.8, 2.0)]}
    assert op.choose_breathing(raised)[:2] == (16.875, "harmonic")
    slow = {"baseline": [(8.4, 9.0), (16.9, 2.0)], "envelope": [(8.4, 8.0), (16.9, 2.0)], "amplitude": [(8.5, 9.0)]}
    assert op.choose_breathing(slow)[0] == 8.4


def test_murmurs_by_their_time(spark):
    rate, cycle = 400, 320
    t = np.arange(20 * cycle)
    at = t % cycle
    sound = lambda c: np.exp(-(((at - c) / 16) ** 2)) * np.sin(2 * np.pi * 40 * t / rate)
    heart = sound(30) + 0.8 * sound(132)
    hum = 0.15 * np.sin(2 * np.pi * 150 * t / rate)
    systolic, diastolic = heart + hum * ((at > 60) & (at < 100)), heart + hum * ((at > 165) & (at < 300))
    rows = sorted(op.murmur_features(frame(spark, systolic, diastolic), float(rate), (20.0, 60.0, 100.0, 130.0, 180.0)).collect())
    assert abs(rows[0].cycle_s - 0.8) < 0.02 and rows[0].systolic_fast > rows[0].diastolic_fast and rows[1].diastolic_fast > rows[1].systolic_fast
    assert rows[1].timing == "diastolic"


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize(("low", "high", "rate"), [(0.5, 8.0, 50.0), (2.0, 3.0, 50.0), (20.0, 180.0, 400.0), (0.05, 0.7, 10.0)])
def test_band_pass_has_the_butterworth_response(order, low, high, rate):
    sections = dsp.bandpass_sections(low, high, rate, order)
    assert sections.shape == (order, 5)
    hz = np.linspace(0.01 * rate, 0.49 * rate, 200)
    z = np.exp(-2j * np.pi * hz / rate)
    h = np.prod([(b0 + b1 * z + b2 * z**2) / (1 + a1 * z + a2 * z**2) for b0, b1, b2, a1, a2 in sections], axis=0)
    w, w1, w2 = (np.tan(np.pi * f / rate) for f in (hz, low, high))
    assert np.allclose(np.abs(h), 1 / np.sqrt(1 + ((w**2 - w1 * w2) / (w * (w2 - w1))) ** (2 * order)), atol=1e-6)


def test_spectrum_of_a_tone(spark):
    t = np.arange(640) / 64
    r = op.spectrum_features(frame(spark, np.sin(2 * np.pi * 10 * t)), 64.0, (0.0, 5.0, 15.0, 32.0)).first()
    assert r.peak_hz == r.median_hz == 10.0 and r.band_1 > 0.99 and abs(r.rms - 0.5**0.5) < 0.01 and r.entropy < 0.4 and abs(r.crest - 2**0.5) < 0.05


def test_pauses_in_breathing(spark):
    t = np.arange(1200) / 10
    x = np.sin(2 * np.pi * 0.25 * t) * np.where((t > 40) & (t < 80), 0.02, 1)
    r = op.breathing_features(frame(spark, x), 10.0).first()
    assert abs(r.rate_bpm - 15) < 1 and 0.2 < r.still < 0.4


def test_longest_fragment(spark):
    line = [(1, x, 5) for x in range(10)] + [(1, 3, 6)]
    blob = [(1, x, y) for x in range(20, 23) for y in range(20, 23)]
    got = sorted(tuple(r) for r in op.fragment_trace(spark.createDataFrame(line + blob + line, "image long, x long, y long")).collect())
    assert got == [(1, x, 5.5 if x == 3 else 5.0) for x in range(10)]


def test_periodogram_kernels_by_their_formula(spark):
    """Median frequency and the spectrogram against sums of cosines, term by term."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6, 64))
    k = np.arange(33)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    y = (x - x.mean(axis=1, keepdims=True)) * w
    c = y @ np.cos(2 * np.pi * np.outer(np.arange(64), k) / 64), y @ np.sin(2 * np.pi * np.outer(np.arange(64), k) / 64)
    p = c[0] ** 2 + c[1] ** 2
    p[:, 1:-1] *= 2
    inside = (k >= 2) & (k <= 30)
    want = [k[inside][np.searchsorted(np.cumsum(row[inside]), row[inside].sum() / 2)] for row in p]
    got = sorted(spectral.median_frequency(frame(spark, *x), 64.0, 2.0, 30.0).collect())
    assert [r.median_hz for r in got] == want and [r.fatigue for r in got] == [bool(v < 32 / 3) for v in want]
    parts = np.stack([x[:, s : s + 32] for s in (0, 16, 32)], axis=1)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 32)
    power = np.abs(np.fft.rfft((parts - parts.mean(axis=2, keepdims=True)) * w, axis=2)) ** 2
    mean = power.mean(axis=1)
    centroid = (mean * np.fft.rfftfreq(32, 1 / 64)).sum(axis=1) / mean.sum(axis=1)
    assert np.allclose([r.centroid_hz for r in sorted(spectral.spectrogram(frame(spark, *x), 64.0).collect())], centroid, atol=1e-5)


def test_cycle_and_sounds_of_a_regular_signal(spark):
    t = np.arange(2000) / 100
    beat = np.exp(-((((t % 0.8) - 0.4) / 0.05) ** 2)) * np.sin(2 * np.pi * 30 * t)
    r = spectral.dominant_cycle(frame(spark, beat), 100.0, 0.4, 1.2).first()
    assert abs(r.cycle_s - 0.8) < 0.02 and r.periodicity > 0.8
    r = cardiac.heart_sounds(frame(spark, beat), 100.0).first()
    assert abs(r.rate_bpm - 75) < 2


def test_artifacts_of_flat_and_clipped_signals(spark):
    rng = np.random.default_rng(1)
    good = np.sin(np.arange(1000) / 16) + 0.05 * rng.standard_normal(1000)
    rows = sorted(cardiac.ecg_artifacts(frame(spark, good, np.clip(3 * good, -1, 1), np.where(np.arange(1000) < 700, 0.3, good)), 125.0).collect())
    assert rows[0].saturation < 0.01 < 0.3 < rows[1].saturation and rows[2].flat > 0.6 and rows[0].sqi >= rows[1].sqi
    assert neuro.drowsiness(frame(spark, good), 64.0).count() == 1
