"""Golden cases, properties and brute force for the operators."""

import io
import struct
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.functions import dsp
from pulsegrid.operators import cardiac, events, intervals, neuro, oximetry, spectral, waveform
from pulsegrid.operators.evaluation import confusion, set_scores, tfidf_top
from pulsegrid.sources import files


def samples(spark, x):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "record long, idx long, x double")


def test_rolling_rms_is_zero_padded(spark):
    got = [r.rms for r in waveform.rolling_rms(samples(spark, [1, 2, 3, 4, 5]), 4).orderBy("idx").collect()]
    assert np.allclose(got, [1.118034, 1.870829, 2.738613, 3.674235, 3.535534], atol=1e-6)


def test_rolling_median_is_zero_padded(spark):
    assert [r["median"] for r in waveform.rolling_median(samples(spark, [1, 2, 3, 4, 5]), 3).orderBy("idx").collect()] == [1, 2, 3, 4, 4]


def test_interval_filter(spark):
    t = np.cumsum([0, 0.8, 0.82, 0.79, 0.81, 1.6, 0.8])
    beats = spark.createDataFrame([(1, i, float(v), 0.0, "a") for i, v in enumerate(t)], "record long, idx long, t double, x double, kind string")
    kept = [round(r.dt, 6) for r in intervals.clean_intervals(beats).orderBy("idx").collect()]
    assert kept == [0.8, 0.82, 0.79, 0.81, 0.8]


def test_runs(spark):
    flags = [False, True, True, False, True, False, True, True, True]
    got = events.runs(samples(spark, flags), F.col("x") > 0, 2).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(1, 3), (6, 9)]


def test_merge_intervals(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.5, 4.0), (1, 6.1, 7.0), (1, 3.0, 3.5)], "record long, start double, end double")
    got = events.merge_intervals(rows, 2.0).orderBy("start").collect()
    assert [(r.start, r.end, r.parts) for r in got] == [(0, 4, 3), (6.1, 7, 1)]


def points(spark, t):
    return spark.createDataFrame([(1, float(v)) for v in t], "record long, t double")


def test_next_after(spark):
    r, p = points(spark, [1, 2, 3]), points(spark, [1.05, 1.30, 2.25, 3.9])
    first = {x.ref: x.target for x in events.next_after(r, p).collect()}
    assert first == {1.0: 1.05, 2.0: 2.25, 3.0: 3.9}
    late = {x.ref: x.target for x in events.next_after(r, p, 0.08).collect()}
    assert late == {1.0: 1.30, 2.0: 2.25, 3.0: 3.9}


def test_previous_within(spark):
    got = {x.target: x.ref for x in events.previous_within(points(spark, [0.10, 0.50, 0.52]), points(spark, [0.54, 0.70, 1.0]), 0.04, 0.30).collect()}
    assert got == {0.54: 0.50, 0.70: 0.52, 1.0: None}


def test_before_next_anchor(spark):
    got = {x.anchor: x.target for x in events.before_next_anchor(points(spark, [1, 3, 5]), points(spark, [2, 6, 7])).collect()}
    assert got == {1.0: 2.0, 3.0: None, 5.0: 6.0}


def test_match_events(spark):
    r = events.match_events(points(spark, [10, 12, 50]), points(spark, [11, 14, 80]), 5.0).first()
    assert (r.tp, r.fp, r.fn, r.f1) == (2, 1, 1, 0.666667)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 50), st.floats(0, 8)), min_size=1, max_size=12))
def test_merging_again_changes_nothing(spark, spans):
    rows = spark.createDataFrame([(1, a, a + d) for a, d in spans], "record long, start double, end double")
    once = events.merge_intervals(rows, 1.0)
    again = events.merge_intervals(once.select("record", "start", "end"), 1.0)
    key = lambda d: sorted((r.start, r.end) for r in d.collect())
    assert key(once) == key(again)


def test_area_below_90(spark):
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([95, 92, 88, 86, 91])], "record long, idx long, spo2 double")
    assert oximetry.hypoxemia_burden(rows).first().area_per_hour == pytest.approx(6 / 60 / (5 / 3600), abs=1e-6)


def test_desaturation_needs_recovery(spark):
    x = [97] * 30 + [92] * 5 + [95] * 2 + [92] * 3 + [97] * 5
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "record long, idx long, spo2 double")
    got = oximetry.desaturations(rows, 3.0, 20, 3).collect()
    assert [(r.start, r.end, r.nadir) for r in got] == [(30, 40, 92.0)]


def test_sets_and_empty_denominators(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"], ["b", "c", "d", "e"]), (2, [], []), (3, ["a"], [])], "id int, expected array<string>, planned array<string>")
    got = {r.id: (r.precision, r.recall, r.f1) for r in set_scores(rows).collect()}
    assert got == {1: (0.5, 0.666667, 0.571429), 2: (1.0, 1.0, 1.0), 3: (0.0, 0.0, 0.0)}
    none = spark.createDataFrame([(False, False)], "truth boolean, pred boolean")
    r = confusion(none).first()
    assert (r.precision, r.recall, r.f1) == (0, 0, 0)


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "x x"), (2, "y"), (3, "z")], "id int, text string")
    r = tfidf_top(spark.createDataFrame([(1, "x")], "q int, text string"), docs, 1).first()
    assert (r.id, r.score) == (1, pytest.approx((1 + np.log(2)) * (np.log(4 / 2) + 1), abs=1e-6))


def test_bandpass_keeps_the_band_and_no_phase():
    t = np.arange(2000) / 100
    slow, mid = np.sin(2 * np.pi * 0.1 * t), np.sin(2 * np.pi * 5 * t)
    y = dsp.bandpass((slow + mid + 3)[None, :], 100, 2, 12)[0]
    assert np.abs(y - mid)[300:-300].max() < 0.05


def test_welch_power_is_variance():
    x = np.random.default_rng(0).standard_normal((3, 4096))
    f, p = dsp.welch(x, 50, 256)
    assert np.allclose(np.trapezoid(p, f, axis=1), x.var(axis=1), rtol=0.06)


def test_find_peaks():
    x = np.array([0, 1, 0, 2, 2, 0, 0.5, 0, 3, 0], float)
    assert dsp.find_peaks(x).tolist() == [1, 3, 6, 8]
    assert dsp.find_peaks(x, height=1).tolist() == [1, 3, 8]
    assert dsp.find_peaks(x, distance=3).tolist() == [3, 8]
    assert dsp.find_peaks(x, prominence=1).tolist() == [1, 3, 8]


def test_envelope_savgol_resample():
    t = np.arange(400) / 100
    assert np.allclose(dsp.envelope(2 * np.cos(2 * np.pi * 5 * t)[None, :])[0], 2, atol=1e-6)
    assert np.allclose(dsp.savgol((t**2)[None, :], 11)[0], t**2)
    x = np.sin(2 * np.pi * 2 * t)[None, :]
    assert np.allclose(dsp.resample(x, 800)[0][::2], x[0], atol=1e-9)


def test_spectral_operators_skip_bad_signals(spark):
    t = np.arange(128) / 64
    rows = spark.createDataFrame([(1, np.sin(2 * np.pi * 10 * t).tolist()), (2, None), (3, []), (4, [float("nan")] * 64)], "record long, values array<double>")
    got = {r.record: r for r in spectral.bandpower(rows, 64.0).collect()}
    assert got[1].alpha > 10 * got[1].beta and got[2].alpha is None and len(got) == 4


def test_minimum_path(spark):
    rows = spark.createDataFrame([(1, x, y) for x in range(6) for y in (10, 30)] + [(1, 6, 12)], "image long, x long, y long")
    assert [r.y for r in spectral.minimum_path(rows).orderBy("x").collect()] == [10.0] * 6 + [12.0]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,signal\n0,1.5\n1,\n2,nan\n3,2.5\n")
    got = files.read_delimited(spark, str(tmp_path / "a.csv")).orderBy("idx").collect()
    assert [(r.idx, r.x) for r in got] == [(0, 1.5), (1, 2.5)]
    (tmp_path / "b.txt").write_text("1,5  2,25\n3 4\nx y\n")
    assert sorted(r["values"] for r in files.read_decimal_comma(spark, str(tmp_path / "b.txt")).collect()) == [[1.5, 2.25], [3.0, 4.0]]
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(1000)
        w.writeframes(struct.pack("<4h", 16384, -16384, 0, 32767))
    (tmp_path / "c.wav").write_bytes(buf.getvalue())
    rows = {r.channel: r for r in files.read_wav(spark, str(tmp_path / "c.wav")).collect()}
    assert rows["0"]["values"] == [0.5, 0.0] and rows["1"].rate == 1000.0


def test_edf():
    pad = lambda s, n: str(s).ljust(n).encode()
    head = pad("0", 8) + pad("", 80) + pad("", 80) + pad("", 16) + pad(512, 8) + pad("", 44) + pad(2, 8) + pad(1, 8) + pad(1, 4)
    sig = pad("ECG", 16) + pad("", 80) + pad("mV", 8) + pad(-1, 8) + pad(1, 8) + pad(-100, 8) + pad(100, 8) + pad("", 80) + pad(3, 8) + pad("", 32)
    (label, rate, x), = files.parse_edf(head + sig + struct.pack("<6h", -100, 0, 100, 50, 0, 0))
    assert (label, rate) == ("ECG", 3.0) and np.allclose(x, [-1, 0, 1, 0.5, 0, 0])


def test_columns():
    from pyspark.sql import types as T

    s = T.StructType([T.StructField("name", T.StringType()), T.StructField("acc_x", T.DoubleType()), T.StructField("acc_y", T.DoubleType()), T.StructField("acc_z", T.DoubleType())])
    assert files.value_column(s) == "acc_x" and files.axis_columns(s) == {"x": "acc_x", "y": "acc_y", "z": "acc_z"}
    with pytest.raises(ValueError):
        files.value_column(s, "missing")


def signal(spark, x):
    return spark.createDataFrame([(1, [float(v) for v in x])], "record long, values array<double>")


def test_breathing_and_apnea(spark):
    t = np.arange(240 * 4) / 4
    x = np.sin(2 * np.pi * 0.25 * t)
    r = neuro.breathing(signal(spark, x), 4.0).first()
    assert r.rate_bpm == pytest.approx(15, abs=0.5) and r.flags == "" and r.unpaired < 0.1
    x[400:520] = 0
    r = neuro.breath_events(signal(spark, x), 4.0).first()
    assert r.apneas == 1 and 20 < r.longest_apnea_s < 32
    assert cardiac.respiration_from_motion(signal(spark, np.sin(2 * np.pi * 0.25 * t)), 4.0).first().rate_bpm == pytest.approx(15, abs=2)


def test_pressure_and_pulse(spark):
    t = np.arange(30 * 50) / 50
    r = cardiac.pressure_pulses(signal(spark, 100 + 20 * np.sin(2 * np.pi * 1.2 * t)), 50.0).first()
    assert r.rate_bpm == pytest.approx(72, abs=2) and r.systolic == pytest.approx(120, abs=1) and r.diastolic == pytest.approx(80, abs=1) and r.map == pytest.approx(93.3, abs=1)
    r = cardiac.pulse_amplitudes(signal(spark, 5 + np.sin(2 * np.pi * 1.2 * t)), 50.0).first()
    assert r.amplitude == pytest.approx(2, abs=0.05) and r.amplitude_cv < 0.1 and r.low_fraction == 0
    assert cardiac.pulse_artifacts(signal(spark, np.ones(400)), 50.0).first().score >= 0.35


def test_bursts_impacts_and_edges(spark):
    rng = np.random.default_rng(0)
    x = 0.01 * rng.standard_normal(4000)
    x[1000:1200] += np.sin(2 * np.pi * 80 * np.arange(200) / 1000)
    assert neuro.muscle_bursts(signal(spark, x), 1000.0).first().bursts == 1
    a = np.ones(500)
    a[200] = 4
    r = neuro.impacts(signal(spark, a), 50.0).first()
    assert (r.impacts, r.fall_like, r.level) == (1, 1, "fall_pattern")
    e = 0.1 * rng.standard_normal(6000)
    e[[1000, 3000]] = 5
    assert neuro.seizure_screen(signal(spark, e), 100.0).first().spikes == 2
    assert neuro.motion_summary(signal(spark, np.ones(100)), 50.0).first().activity == "low"


def test_mechanical_beats(spark):
    rate, n = 50, 50 * 40
    x = np.zeros(n)
    for p in range(25, n - 25, 40):  # 75 a minute
        x[p - 10 : p + 10] += np.hanning(20) * np.sin(2 * np.pi * 6 * np.arange(20) / rate)
    r = cardiac.ballisto_rhythm(signal(spark, x), float(rate)).first()
    assert r.rate_bpm == pytest.approx(75, abs=2) and r.risk == "low_irregularity"
    assert cardiac.bed_presence(signal(spark, np.zeros(200)), float(rate)).first().state == "empty_or_no_cardiac_signal"
