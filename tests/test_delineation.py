"""Waves with known ends: onsets and offsets within 10 ms."""

import numpy as np
import pytest

from pulsegrid.operators import delineation as op
from pulsegrid.operators.beat_detection import r_peak_lists


def synthetic(rate, seed, noise=0.0, seconds=12, p=True, t_sign=1.0):
    """Waves of finite length: P and T are raised cosines, the complex three triangles."""
    rng = np.random.default_rng(seed)
    time = np.arange(int(seconds * rate)) / rate
    x, beats, at = noise * rng.standard_normal(len(time)), [], 0.7

    def bump(a, z, height):
        inside = (time >= a) & (time <= z)
        x[inside] += height * (1 - np.cos(2 * np.pi * (time[inside] - a) / (z - a))) / 2

    def tooth(a, top, z, height):
        x[:] += height * np.clip(np.minimum((time - a) / (top - a), (z - time) / (z - top)), 0, None)

    while at < seconds - 0.8:
        pw, tw = rng.uniform(0.08, 0.11), rng.uniform(0.15, 0.2)
        p_on = at - 0.05 - rng.uniform(0.06, 0.08) - pw
        t_on = at + 0.06 + rng.uniform(0.08, 0.12)
        if p:
            bump(p_on, p_on + pw, 0.15)
        tooth(at - 0.045, at - 0.03, at - 0.015, -0.15)
        tooth(at - 0.02, at, at + 0.02, 1.0)
        tooth(at + 0.015, at + 0.03, at + 0.05, -0.25)
        bump(t_on, t_on + tw, 0.3 * t_sign)
        beats.append({"p_on": p_on, "p_peak": p_on + pw / 2, "p_off": p_on + pw, "qrs_on": at - 0.045, "r_peak": at, "qrs_off": at + 0.05, "t_on": t_on, "t_peak": t_on + tw / 2, "t_off": t_on + tw})
        at += rng.uniform(0.75, 0.95)
    return x, beats


def errors(rate, seed, **kw):
    """Seconds by which each place is off, by wave."""
    x, beats = synthetic(rate, seed, **kw)
    peaks, _, _ = r_peak_lists(x[None], rate)
    assert len(peaks[0]) == len(beats)
    rows = op.delineate_row(op.scales(x[None], rate)[:, 0], peaks[0], rate)
    return {k: np.array([np.nan if r[k] is None else r[k] / rate - b[k] for r, b in zip(rows, beats, strict=True)]) for k in op.WAVES}


@pytest.mark.parametrize("rate", [250.0, 500.0, 360.0])
@pytest.mark.parametrize("t_sign", [1.0, -1.0])
def test_ends_within_ten_milliseconds(rate, t_sign):
    for seed in range(4):
        for k, e in errors(rate, seed, t_sign=t_sign).items():
            assert not np.isnan(e).any() and np.abs(e).max() <= 0.010 + 0.5 / rate, (k, seed, np.round(e * 1000, 1))


def test_noise():
    for seed in range(4):
        for k, e in errors(250.0, seed, noise=0.004).items():
            assert np.isnan(e).mean() < 0.1 and np.nanmedian(np.abs(e)) <= 0.010, (k, seed, np.round(e * 1000, 1))


def test_missing_waves_are_null(spark):
    rate, (x, beats), (y, _) = 250.0, synthetic(250.0, 1, p=False), synthetic(250.0, 2)
    rows = [(1, x.tolist()), (2, y.tolist()), (3, None), (4, [0.0] * 500), (5, [None, 1.0] * 30)]
    got = op.delineate(spark.createDataFrame(rows, "record long, values array<double>"), rate)
    found = got.collect()
    assert {r.record for r in found} == {1, 2} and len([r for r in found if r.record == 1]) == len(beats)
    assert sum(r.p_peak is not None for r in found if r.record == 1) == 0 and all(r.t_peak is not None for r in found)
    d = {r.record: r for r in op.wave_durations(got, rate).collect()}
    assert d[1].p_waves == 0 and d[1].pr_s is None and abs(d[2].qrs_s - 0.095) <= 0.012 and d[2].beats == d[2].t_waves


def test_scales_are_in_place():
    """A step's slope is steepest at the step on every scale."""
    x = np.zeros((1, 400))
    x[:, 200:] = 1.0
    for rate in (250.0, 500.0):
        for w in op.scales(x, rate):
            assert abs(np.abs(w[0]).argmax() - 199.5) <= 1.5
