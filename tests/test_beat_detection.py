"""R peaks on synthetic electrocardiograms, and heart sounds against a search of every phase."""

import numpy as np
import pytest

from pulsegrid.functions import dsp
from pulsegrid.operators import beat_detection as op

RATE = 250.0


def electrocardiogram(seed, noise, seconds=40, wander=0.5):
    """P, QRS and T waves at irregular beats of varying height; a beat in fifteen is low."""
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * RATE)) / RATE
    x, beats, at = wander * np.sin(2 * np.pi * 0.3 * t) + noise * rng.standard_normal(len(t)), [], 0.6
    while at < seconds - 0.6:
        size = rng.uniform(0.8, 1.2) * (0.45 if rng.random() < 1 / 15 else 1)
        for shift, height, width in ((-0.17, 0.12, 0.022), (-0.026, -0.12, 0.009), (0, 1.0, 0.011), (0.027, -0.2, 0.01), (0.27, 0.3, 0.045)):
            x += size * height * np.exp(-(((t - at - shift) / width) ** 2) / 2)
        beats.append(round(at * RATE))
        at += rng.uniform(0.65, 0.95)
    return x, np.array(beats)


def f1(found, beats, reach=0.05 * RATE):
    hit = sum(np.abs(found - b).min(initial=1e9) <= reach for b in beats)
    return 2 * hit / (len(found) + len(beats))


@pytest.mark.parametrize("noise", [0.0, 0.05, 0.1])
def test_r_peaks(noise):
    scores, exact = [], []
    for seed in range(8):
        x, beats = electrocardiogram(seed, noise)
        (found,), _, (method,) = op.r_peak_lists(x[None], RATE)
        scores.append(f1(found, beats))
        exact += [np.abs(beats - p).min() for p in found]
        assert method == "adaptive"
    assert min(scores) >= 0.97 and np.mean(scores) >= 0.98
    assert np.mean(np.array(exact) <= 2) > 0.97


def test_search_back_finds_low_beats():
    t = np.arange(int(20 * RATE)) / RATE
    x = sum((0.3 if k in (9, 17) else 1.0) * np.exp(-(((t - 0.7 - 0.8 * k) / 0.012) ** 2) / 2) for k in range(23))
    (found,), (back,), _ = op.r_peak_lists(x[None], RATE)
    assert len(found) == 23 and back >= 1


def test_tall_t_waves_are_no_beats():
    t = np.arange(int(20 * RATE)) / RATE
    x = sum(np.exp(-(((t - 0.7 - 0.8 * k) / 0.012) ** 2) / 2) + 0.9 * np.exp(-(((t - 0.97 - 0.8 * k) / 0.05) ** 2) / 2) for k in range(23))
    (found,), _, _ = op.r_peak_lists(x[None], RATE)
    assert len(found) == 23


def test_r_peaks_of_rows(spark):
    x, beats = electrocardiogram(1, 0.05)
    rows = [(1, x.tolist()), (2, None), (3, []), (4, [0.0] * 600), (5, [None, 1.0] * 40), (6, (-x).tolist()), (None, x.tolist())]
    got = {r.record: r for r in op.r_peaks(spark.createDataFrame(rows, "record long, values array<double>"), RATE).collect()}
    for k in (1, 6, None):  # upside down is found as well
        assert f1(np.array(got[k].peaks), beats) > 0.98 and got[k].confidence == 0.82 and got[k].beats == len(got[k].peaks)
        assert abs(got[k].heart_rate_bpm - 60 * RATE / np.median(np.diff(beats))) < 1
    assert got[2].peaks is got[3].peaks is got[5].peaks is None and got[4].peaks == [] and got[4].confidence == 0.3
    assert op.r_peaks(spark.createDataFrame([], "record long, values array<double>"), RATE).count() == 0


def sounds(seed, rate=500.0, cycle=0.8, seconds=12, noise=0.02):
    rng = np.random.default_rng(seed)
    t, at = np.arange(int(seconds * rate)) / rate, rng.uniform(0.1, 0.5)
    x = noise * rng.standard_normal(len(t))
    first = np.arange(at, seconds - 0.5, cycle)
    for s in first:
        for shift, size in ((0, 1.0), (0.32 * cycle, 0.6)):
            x += size * np.sin(2 * np.pi * 60 * t) * np.exp(-(((t - s - shift) / 0.02) ** 2) / 2)
    return x, first


def brute_scores(env, cycle, delay, rate):
    n, half, out = len(env), int(0.06 * rate), []
    for phase in range(cycle):
        parts = []
        for s1 in range(phase, n, cycle):
            for at, weight in ((s1, 1.0), (s1 + delay, 0.85)):
                lo, hi = max(0, at - half), min(n, at + half + 1)
                if hi > lo:
                    parts.append(weight * env[lo:hi].max())
        out.append(np.mean(parts))
    return np.array(out)


def test_all_phases():
    rng = np.random.default_rng(3)
    env, cycle, delay = rng.random((6, 300)), np.array([17, 40, 33, 64, 21, 55]), np.array([5, 13, 11, 20, 7, 18])
    got = op.phase_scores(env, cycle, delay, 60.0)
    for k in range(6):
        assert np.allclose(got[k, : cycle[k]], brute_scores(env[k], cycle[k], delay[k], 60.0)) and (got[k, cycle[k] :] == -np.inf).all()


def test_decoded_sounds():
    x, first = zip(*(sounds(k) for k in range(5)), strict=True)
    got = op.decode_sounds(np.array(x), 500.0)
    for k in range(5):
        assert abs(got["cycle"][k] - 0.8) < 0.01 and got["sure"][k] > 0.8
        s1 = np.array(got["s1"][k]) / 500
        assert all(np.abs(s1 - f).min() < 0.03 for f in first[k]) and all(np.abs(np.array(got["s2"][k]) / 500 - f - 0.256).min() < 0.03 for f in first[k])
        env = op.sound_envelope(np.array(x), 500.0)[k]
        peaks = dsp.find_peaks(env, distance=60, prominence=max(env.std() * 0.25, 0.03))[:12]
        cycle = round(got["cycle"][k] * 500)
        score = brute_scores(env, cycle, round(np.clip(0.32 * got["cycle"][k], 0.18, 0.45) * 500), 500.0)
        assert got["phase"][k] == max(peaks % cycle, key=lambda p: score[p])


def test_sound_rows_and_phases(spark):
    x, first = sounds(1)
    rows = [(1, x.tolist()), (2, None), (3, [0.0] * 1200), (4, [1.0] * 5)]
    found = op.heart_sounds(spark.createDataFrame(rows, "record long, values array<double>"), 500.0)
    got = {r.record: r for r in found.collect()}
    assert got[2].s1 is None and got[4].s1 is None and got[3].s1 == [] and got[3].confidence == 0.1
    phases = op.sound_phases(found, 500.0).collect()
    assert {r.record for r in phases} == {1} and len(phases) == len(got[1].s1)
    inner = [r for r in phases if r.diastole_s is not None]
    assert np.allclose([r.systole_s for r in inner], 0.256, atol=0.03) and np.allclose([r.systole_s + r.diastole_s for r in inner], 0.8, atol=0.03)
