"""Scales of rendered grids and traces, and windows over axes of known mixtures."""

import numpy as np
import pytest

from pulsegrid.functions import dsp
from pulsegrid.operators import image_scale, multi_axis

PIXELS, SIZES = "image long, x int, y int, grey int", "image long, width int, height int"


def drawn(image: int, width: int, height: int, step_x: int, step_y: int, thick: int = 1, keep: float = 1.0, seed: int = 0) -> list[tuple]:
    """Grid lines with holes and a wave across."""
    rng = np.random.default_rng(seed)
    rows = [(image, x + t, y, 200) for x in range(6, width - thick, step_x) for t in range(thick) for y in range(height) if rng.random() < keep]
    rows += [(image, x, y + t, 205) for y in range(4, height - thick, step_y) for t in range(thick) for x in range(width) if rng.random() < keep]
    return rows + [(image, x, int(height / 2 + 20 * np.sin(x / 7)), 20) for x in range(width)]


def test_scale_of_rendered_grids(spark):
    rows = drawn(1, 400, 150, 40, 25, 1, 0.9) + drawn(2, 330, 210, 33, 30, 2) + [(3, x, 50, 20) for x in range(60)] + [(None, 1, 1, 0), (4, None, 3, 0), (5, 7, 8, 240)]
    sizes = spark.createDataFrame([(1, 400, 150), (2, 330, 210), (3, 400, 150), (5, 20, 20)], SIZES)
    df = spark.createDataFrame(rows + rows[:500], PIXELS)
    got = {r.image: r for r in image_scale.axis_scale(df, sizes, 0.2, 0.5).collect()}
    assert set(got) == {1, 2, 3, 5}
    assert (got[1].spacing_x, got[1].spacing_y, got[1].lines_x, got[1].lines_y) == (40.0, 25.0, 10, 6)
    assert (got[2].spacing_x, got[2].spacing_y, got[2].lines_x, got[2].lines_y) == (33.0, 30.0, 10, 7)
    assert got[1].duration_s == pytest.approx(2.0) and got[1].rate_hz == pytest.approx(200.0) and got[1].value_span == pytest.approx(3.0, abs=0.1) and got[1].confidence == 0.95
    assert got[3].spacing_x is None and got[3].missing == "duration,value_per_grid" and got[3].confidence == 0.25
    assert got[5].lines_x == 0 and got[5].x_min == 7
    given = {r.image: r for r in image_scale.axis_scale(df, sizes, duration_s=4.0).collect()}
    assert given[3].rate_hz == 15.0 and given[3].missing == "value_per_grid"
    thick = {(r.image, r.axis, r.line): r for r in image_scale.ruled_lines(df, sizes).collect()}
    assert thick[2, "x", 1].thickness == 2 and thick[2, "x", 1].centre == 6.5
    assert image_scale.axis_scale(df.limit(0), sizes).count() == 0
    # profiles hold every column once, and the comb finds the same spacing
    p = {r.record: r.values for r in image_scale.profiles(df, sizes).collect()}
    assert len(p[1]) == 400 and len(p[2]) == 330 and max(p[1]) <= 1
    comb = {r.record: r for r in image_scale.comb_spacing(image_scale.profiles(df, sizes)).collect()}
    assert comb[1].spacing == pytest.approx(40, abs=0.3) and comb[2].spacing == pytest.approx(33, abs=0.3)


def test_comb_of_faint_grids(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k, step in enumerate((8.0, 12.5, 17.3, 31.0, 60.4)):
        v = 0.1 * rng.random(640)
        v[np.round(np.arange(3, 636, step)).astype(int)] += 0.25
        rows.append((k, v.tolist(), step))
    rows += [(9, rng.random(640).tolist(), None), (10, [0.5] * 640, None), (11, None, None), (12, [1.0], None)]
    got = {r.record: r.spacing for r in image_scale.comb_spacing(spark.createDataFrame([r[:2] for r in rows], "record long, values array<double>")).collect()}
    for k, _, step in rows:
        assert got[k] is None if step is None else abs(got[k] - step) < 0.35, (k, got[k])


def test_choice_of_durations(spark):
    n = 600
    t = np.arange(n) / n
    beat = lambda beats, sign: (sign * np.maximum(0, np.cos(2 * np.pi * beats * t)) ** 6).tolist()
    rows = [(1, beat(12.3, 1)), (2, beat(12.3, -1)), (4, [0.0] * n), (5, None)]
    df = spark.createDataFrame(rows, "record long, values array<double>")
    got = {r.record: r for r in image_scale.choose_duration(df, [(1.0, 0.35), (10.0, 0.35), (60.0, 0.35)], "ppg").collect()}
    assert got[1].duration_s == got[2].duration_s == 10.0
    assert got[1].bpm == pytest.approx(12.3 * 6, abs=2) and got[1].rate_hz == 60.0 and got[1].confirm and got[5].duration_s is None
    assert got[4].peaks == 0 and got[4].confirm
    y = np.array(rows[0][1]) - np.median(rows[0][1])
    seen = {s: image_scale.peak_evidence(y, n / s, 35.0, 220.0) for s in (10.0, 60.0)}
    assert seen[10.0][1:3] == (1.0, 12) and seen[60.0][1] == pytest.approx(12.3 / 35, abs=0.02) and seen[10.0][0] > seen[60.0][0] + 0.2
    # where several are plausible the prior leads
    lead = image_scale.choose_duration(df.where("record = 1"), [(9.0, 0.9), (10.0, 0.1)], "ppg").first()
    assert lead.duration_s == 9.0 and not lead.confirm and lead.margin > 0.12


def test_windows_over_axes(spark):
    rng = np.random.default_rng(6)
    rate, n = 200.0, 200 * 50
    t = np.arange(n) / rate
    beats = np.arange(0.7, 49.5, 0.8)
    shape = lambda at, w: sum(np.exp(-(((t - b - at) / w) ** 2)) * np.sin(2 * np.pi * 12 * (t - b - at)) for b in beats)
    lat = shape(0.1, 0.05) + 0.02 * rng.standard_normal(n)
    hf = 0.5 * shape(0.1, 0.05) + 0.02 * rng.standard_normal(n)
    dv = rng.standard_normal(n)
    ecg = sum(np.exp(-(((t - b) / 0.012) ** 2)) for b in beats) + 0.01 * rng.standard_normal(n)
    gone = dv.tolist()
    gone[5], gone[77] = None, float("nan")
    rows = [(1, lat.tolist(), hf.tolist(), dv.tolist(), ecg.tolist()), (2, lat.tolist(), hf.tolist(), gone, ecg[: 200 * 25].tolist()), (3, lat.tolist(), None, dv.tolist(), None), (4, [1.0] * 5, [1.0] * 5, [1.0] * 5, None), (5, lat[:300].tolist(), hf[:300].tolist(), dv[:400].tolist(), None)]
    df = spark.createDataFrame(rows, "record long, lat array<double>, hf array<double>, dv array<double>, ecg array<double>")
    windows = multi_axis.axis_windows(df, rate, 20.0, 10.0).cache()
    got = {(r.record, r.window): r for r in windows.collect()}
    assert sorted(k for k in got if k[0] == 1) == [(1, w) for w in range(4)] and {k[0] for k in got} == {1, 2, 5} and (5, 1) not in got
    r = got[1, 1]
    assert r.start_s == 10.0 and r.hr_bpm == pytest.approx(75, abs=0.5) and 24 <= r.beats <= 26 and r.rr_cv < 0.02
    assert r.beat_lat_likeness > 0.9 and r.beat_hf_likeness > 0.9 and abs(r.beat_dv_likeness) < 0.3
    assert r.beat_lat_span == pytest.approx(2 * r.beat_hf_span, rel=0.1)
    assert r.coherence_lat_hf > r.coherence_lat_dv + 0.3 and r.coherence_lat_hf > 0.6
    assert r.lat_std == pytest.approx(2 * r.hf_std, rel=0.05)
    # against plain numpy on the filtered axis
    y = dsp.resample(dsp.bandpass(lat[None], rate, 0.8, 35.0), n // 2)[0][1000:3000]
    y = y - np.median(y)
    assert r.lat_std == pytest.approx(y.std(), abs=2e-6) and r.lat_iqr == pytest.approx(np.percentile(y, 75) - np.percentile(y, 25), abs=2e-6)
    assert r.lat_cardiac_ratio > 0.95 and r.lat_systolic_ratio > 0.9 and r.lat_noise_ratio < 0.05 and r.dv_noise_ratio > r.lat_noise_ratio
    assert (2, 3) not in got and got[2, 0].beats is not None and got[2, 2].beats is None and got[2, 2].beat_lat_span is None and got[5, 0].coherence_lat_hf is None
    told = {r.record: r for r in multi_axis.axis_summary(windows).collect()}
    assert (told[1].windows, told[1].with_beats, told[1].best_pair) == (4, 4, "lat_hf") and told[1].best_axis in ("lat", "hf") and told[5].best_axis is None
    assert multi_axis.axis_windows(df.limit(0), rate).count() == 0


def test_coherence_of_known_mixtures():
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal((2, 3, 20_000))
    same, none, half = (multi_axis.coherence(a, y, 100.0) for y in (3 * a, b, a + b))
    assert np.allclose(same, 1) and (none < 0.05).all() and np.allclose(half, 0.5, atol=0.06)
