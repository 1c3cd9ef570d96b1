"""Kernels whose queries have no SQL: values on signals with known figures, and loops written out."""

import cmath
import math

import numpy as np

from pulsegrid.operators import cardiac, neuro, spectral

SIGNALS = "record long, values array<double>"


def slow_welch(x, rate, segment):
    """Density at each frequency, term by term."""
    m = min(segment, len(x))
    hann = [0.5 - 0.5 * math.cos(2 * math.pi * k / m) for k in range(m)]
    norm = rate * sum(h * h for h in hann)
    total, parts = [0.0] * (m // 2 + 1), 0
    for s in range(0, len(x) - m + 1, m - m // 2):
        part = x[s : s + m]
        mean = sum(part) / m
        part = [(v - mean) * h for v, h in zip(part, hann, strict=True)]
        parts += 1
        for k in range(m // 2 + 1):
            p = abs(sum(v * cmath.exp(-2j * math.pi * k * t / m) for t, v in enumerate(part))) ** 2 / norm
            total[k] += p * (1 if k == 0 or (m % 2 == 0 and k == m // 2) else 2)
    return [k * rate / m for k in range(m // 2 + 1)], [t / parts for t in total]


def band(f, p, low, high):
    at = [k for k, v in enumerate(f) if low <= v < high]
    return sum((p[a] + p[b]) / 2 * (f[b] - f[a]) for a, b in zip(at[:-1], at[1:], strict=True))


def test_interval_spectrum(spark):
    t, rows = 0.0, []
    for _ in range(130):
        dt = 0.8 + 0.03 * math.sin(2 * math.pi * 0.1 * t) + 0.05 * math.sin(2 * math.pi * 0.25 * t)
        t += dt
        rows.append((1, t, dt))
    rows += [(2, float(k), 1.0) for k in range(7)] + [(3, k / 10, 0.1) for k in range(60)]
    got = {r.record: r for r in spectral.hrv_frequency(spark.createDataFrame(rows, "record long, t double, dt double").repartition(4)).collect()}
    ts, vs = [r[1] for r in rows if r[0] == 1], [1000 * r[2] for r in rows if r[0] == 1]
    grid, at = [], ts[0]
    k = 0
    while ts[0] + k / 4 < ts[-1]:
        at = ts[0] + k / 4
        j = max(i for i in range(len(ts)) if ts[i] <= at)
        grid.append(vs[j] if j + 1 == len(ts) else vs[j] + (vs[j + 1] - vs[j]) * (at - ts[j]) / (ts[j + 1] - ts[j]))
        k += 1
    f, p = slow_welch(grid, 4.0, 256)
    lf, hf = band(f, p, 0.04, 0.15), band(f, p, 0.15, 0.4)
    assert abs(got[1].lf - lf) < 1e-5 * lf + 1e-5 and abs(got[1].hf - hf) < 1e-5 * hf + 1e-5 and abs(got[1].lf_hf - lf / hf) < 1e-4
    assert got[1].n == 130 and 0.2 < got[1].lf_hf < 0.6  # amplitudes 3 to 5, as squares
    assert got[2].lf is None and got[3].lf is None and (got[2].n, got[3].n) == (7, 60)


def test_st_levels(spark):
    rate = 250.0
    t = np.arange(int(10 * rate)) / rate
    rows = []
    for record, st in enumerate([0.0, -0.18, -0.35]):
        x = np.zeros(len(t))
        for at in np.arange(0.6, 9.4, 0.8):
            x += np.exp(-(((t - at) / 0.012) ** 2) / 2)
            x[(t >= at + 0.06) & (t <= at + 0.15)] += st
        rows.append((record, x.tolist()))
    got = {r.record: r for r in cardiac.st_features(spark.createDataFrame([*rows, (9, None)], SIGNALS), rate).collect()}
    for record, (st, flag) in enumerate([(0.0, "none"), (-0.18, "possible"), (-0.35, "marked")]):
        r = got[record]
        assert abs(r.st - st) < 0.02 and abs(r.t_wave) < 0.02 and abs(r.r_wave - 1) < 0.1 and r.st_flag == flag and r.beats == 11, r
    assert got[9].st is None


def test_arousal(spark):
    rate = 4.0
    t = np.arange(int(120 * rate)) / rate
    calm = np.full(len(t), 5.0)
    busy = 5 + sum(6.0 * np.exp(-(((t - at) / 0.3) ** 2)) for at in range(5, 116, 5))
    got = {r.record: r for r in neuro.arousal(spark.createDataFrame([(1, calm.tolist()), (2, busy.tolist())], SIGNALS), rate).collect()}
    assert got[1].level == "low" and got[2].level == "elevated" and got[2].peaks == 23 and abs(got[2].peaks_per_min - 11.5) < 1e-6


def test_arbitration_follows_the_envelope(spark):
    rate = 128.0
    t = np.arange(int(8 * rate)) / rate
    rows = [(k, (np.sin(2 * np.pi * 10 * t) * (1 + np.sin(2 * np.pi * hz * t))).tolist()) for k, hz in ((1, 1.25), (2, 1.5))]
    got = {r.record: r for r in spectral.candidate_arbitration(spark.createDataFrame(rows, SIGNALS), rate, [(2.0, 8.0), (4.0, 16.0), (6.0, 24.0)]).collect()}
    for k, hz in ((1, 1.25), (2, 1.5)):
        assert abs(got[k].spectral_bpm - 60 * hz) <= 60 / 8 and 0 <= got[k].band <= 2 and 0 <= got[k].score <= 1
