"""Pulse, pressure and heartbeat analyses that need peaks: signals as arrays, one row each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..functions import dsp
from .beat_detection import r_peak_lists
from .spectral import per_signal


def _r(x) -> np.ndarray:
    return np.round(np.array(x, float), 6)


def _cv(x: np.ndarray) -> float:
    return float(x.std() / x.mean()) if len(x) > 1 and x.mean() > 0 else np.nan


def _median(x: np.ndarray) -> float:
    return float(np.median(x)) if len(x) else np.nan


def _near(dt: np.ndarray, low: float, high: float, floor: float, least: int) -> np.ndarray:
    """Plausible intervals near their median."""
    dt = dt[(dt >= low) & (dt <= high)]
    if len(dt) < least:
        return dt
    m = np.median(dt)
    return dt[np.abs(dt - m) <= max(floor, 4.5 * (np.median(np.abs(dt - m)) + 1e-8))]


def pulse_peaks(row: np.ndarray, rate: float, low: float = 0.5, high: float = 8.0) -> np.ndarray:
    """Systolic peaks of one pulse wave: filtered, by robust prominence, at most 220 a minute."""
    y = dsp.bandpass(row[None, :], rate, low, high)[0]
    spread = 1.4826 * np.median(np.abs(y - np.median(y))) or y.std()
    return dsp.find_peaks(y, distance=max(1, int(60 / 220 * rate)), prominence=max(0.35 * spread, 1e-8))


def jpeaks(x: np.ndarray, rate: float, low: float, high: float) -> list[np.ndarray]:
    """Beats of mechanical signals: peaks of the smoothed envelope, moved to the top of the filtered signal nearby."""
    y = dsp.bandpass(x, rate, low, high)
    width = min(max(5, int(0.16 * rate) | 1), (x.shape[1] - 1) | 1)
    env = dsp.savgol(dsp.envelope(y), width)
    reach, out = max(1, int(0.12 * rate)), []
    for e, v in zip(env, y, strict=True):
        spread = 1.4826 * np.median(np.abs(e - np.median(e))) or e.std()
        peaks = dsp.find_peaks(e, distance=max(1, int(rate / 3)), prominence=max(0.7 * spread, 1e-8))
        out.append(np.unique([max(0, p - reach) + v[max(0, p - reach) : p + reach + 1].argmax() for p in peaks]).astype(int))
    return out


def ballisto_rhythm(signals: DataFrame, rate: float) -> DataFrame:
    """Rate, variability and irregularity of mechanical heartbeats; risk from 0.38 and 0.65."""

    def f(x):
        rows = []
        for p in jpeaks(x, rate, 2.5, 12.0):
            dt = _near(np.diff(p) / rate, 0.28, 2.2, 0.22, 4)
            d = 1000 * np.diff(dt)
            cv, rmssd, p50 = _cv(dt), np.sqrt((d**2).mean()) if len(d) else np.nan, (np.abs(d) > 50).mean() if len(d) else np.nan
            score = 0.55 * min(cv / 0.35, 1) + 0.25 * min(rmssd / 180, 1) + 0.2 * min(p50 / 0.45, 1) if len(dt) >= 3 else np.nan
            rows.append((len(p), 60 / np.median(dt) if len(dt) else np.nan, 1000 * dt.std(ddof=1) if len(dt) > 1 else np.nan, rmssd, score))
        n, bpm, sdnn, rmssd, score = (np.array(c, float) for c in zip(*rows, strict=True))
        risk = np.select([np.isnan(score), score >= 0.65, score >= 0.38], ["unknown", "elevated_irregularity", "borderline_irregularity"], "low_irregularity")
        return {"peaks": n.astype(int), "rate_bpm": _r(bpm), "sdnn_ms": _r(sdnn), "rmssd_ms": _r(rmssd), "score": _r(score), "risk": risk.astype(object)}

    return per_signal(signals, "peaks long, rate_bpm double, sdnn_ms double, rmssd_ms double, score double, risk string", f)


def bed_presence(signals: DataFrame, rate: float) -> DataFrame:
    """Empty, moving or quiet, from the share of steps beyond median + 6 MAD and from beats."""

    def f(x):
        step = np.abs(np.diff(x, axis=1))
        m = np.median(step, axis=1, keepdims=True)
        burst = (step > m + 6 * (np.median(np.abs(step - m), axis=1, keepdims=True) + 1e-8)).mean(axis=1)
        span = np.percentile(x, 95, axis=1) - np.percentile(x, 5, axis=1)
        beats = np.array([len(p) for p in jpeaks(x, rate, 2.5, 12.0)])
        state = np.select([(span <= 1e-8) | (beats < 3), burst > 0.08], ["empty_or_no_cardiac_signal", "present_with_motion"], "present_quiet")
        return {"burst_fraction": _r(burst), "motion_energy": _r(m[:, 0]), "beats": beats, "state": state.astype(object)}

    return per_signal(signals, "burst_fraction double, motion_energy double, beats long, state string", f)


def respiration_from_motion(signals: DataFrame, rate: float) -> DataFrame:
    """Breaths a minute from the baseline or the cardiac envelope, whichever holds more of its power in the breathing band."""

    def f(x):
        top = min(0.7, 0.45 * rate)
        heart = dsp.envelope(dsp.bandpass(x, rate, 1.0, min(12.0, 0.45 * rate)))
        ratio, bpm, source = np.full(len(x), -1.0), np.full(len(x), np.nan), np.full(len(x), "none", object)
        for name, y in (("baseline", x), ("envelope", heart)):
            y = dsp.bandpass(y, rate, 0.08, top)
            hz, p = dsp.welch(y, rate, int(32 * rate))
            at = (hz >= 0.08) & (hz <= top)
            if at.sum() < 2:
                continue
            q = np.trapezoid(p[:, at], hz[at], axis=1) / (np.trapezoid(p, hz, axis=1) + 1e-12)
            better = q > ratio
            ratio[better], source[better] = q[better], name
            bpm[better] = 60 * hz[at][p[:, at].argmax(axis=1)][better]
        return {"rate_bpm": _r(bpm), "power_ratio": _r(np.maximum(ratio, 0)), "source": source}

    return per_signal(signals, "rate_bpm double, power_ratio double, source string", f)


def pressure_pulses(signals: DataFrame, rate: float) -> DataFrame:
    """Plausible pressure pulses: systolic, diastolic, mean and pulse pressure, rate and variation.

    A pulse is a peak of the smoothed signal with the lowest point since the peak before;
    plausible are peaks of 40 - 250, feet of 20 - 180 and pulse pressures of 5 - 140.
    """

    def f(x):
        width = min(max(5, int(0.08 * rate) | 1), (x.shape[1] - 1) | 1)
        rows = []
        for s in dsp.savgol(x, width):
            peaks = dsp.find_peaks(s, distance=max(1, int(0.3 * rate)), prominence=max(0.12 * s.std(), 2.0))
            peaks = peaks[(s[peaks] >= 40) & (s[peaks] <= 250)]
            foot = np.array([s[(peaks[i - 1] if i else max(0, p - int(0.8 * rate))) : p + 1].min() for i, p in enumerate(peaks)])
            top = s[peaks]
            ok = (foot >= 20) & (foot <= 180) & (top - foot >= 5) & (top - foot <= 140) if len(peaks) else np.zeros(0, bool)
            top, foot = top[ok], foot[ok] if len(peaks) else foot
            dt = np.diff(peaks[ok]) / rate
            dt = dt[(dt >= 0.3) & (dt <= 2.0)]
            rows.append((int(ok.sum()), _median(top), _median(foot), _median(foot + (top - foot) / 3), _median(top - foot), 60 / np.median(dt) if len(dt) else np.nan, _cv(dt)))
        n, s, d, m, pp, bpm, cv = (np.array(c, float) for c in zip(*rows, strict=True))
        return {"pulses": n.astype(int), "systolic": _r(s), "diastolic": _r(d), "map": _r(m), "pulse_pressure": _r(pp), "rate_bpm": _r(bpm), "interval_cv": _r(cv)}

    return per_signal(signals, "pulses long, systolic double, diastolic double, map double, pulse_pressure double, rate_bpm double, interval_cv double", f)


def pulse_artifacts(signals: DataFrame, rate: float) -> DataFrame:
    """Flat, saturated, wandering and noisy shares of a pulse wave, and their capped sum."""

    def f(x):
        lo, p5, p95, hi = np.percentile(x, [1, 5, 95, 99], axis=1)
        span = p95 - p5
        flat = (np.abs(np.diff(x, axis=1)) <= np.maximum(span * 1e-4, 1e-8)[:, None]).mean(axis=1)
        sat = ((x <= (lo + span * 1e-3)[:, None]) | (x >= (hi - span * 1e-3)[:, None])).mean(axis=1)
        sat = np.where(span > 0, sat, 1.0)
        hz, p = dsp.welch(x - np.median(x, axis=1, keepdims=True), rate, int(8 * rate))
        total = np.trapezoid(p, hz, axis=1) + 1e-12
        part = lambda at: np.trapezoid(p[:, at], hz[at], axis=1) / total if at.any() else np.zeros(len(x))
        wander, noise = part(hz < 0.3), part(hz > min(8.0, 0.35 * rate))
        score = np.minimum(0.35, 2 * flat) + np.minimum(0.25, 1.5 * np.maximum(0, sat - 0.08)) + np.minimum(0.25, 0.8 * np.maximum(0, wander - 0.45)) + np.minimum(0.2, 0.8 * np.maximum(0, noise - 0.2))
        return {"flat": _r(flat), "saturated": _r(sat), "wander": _r(wander), "noise": _r(noise), "score": _r(np.minimum(1, score))}

    return per_signal(signals, "flat double, saturated double, wander double, noise double, score double", f)


def pulse_amplitudes(signals: DataFrame, rate: float) -> DataFrame:
    """Trough-to-peak heights of pulses: median, variation, perfusion against the level, share of low ones, half-height width, alternans."""

    def f(x):
        rows = []
        for v in x:
            peaks, amp, width = pulse_peaks(v, rate), [], []
            for i, p in enumerate(peaks):
                a = int(peaks[i - 1]) if i else max(0, int(p) - max(1, int(0.55 * rate)))
                b = int(peaks[i + 1]) if i + 1 < len(peaks) else min(len(v) - 1, int(p) + int(round(1.2 * rate)))
                if p <= a + 1:
                    continue
                left = a + int(v[a : p + 1].argmin())
                right = int(p) + int(v[p : b + 1].argmin())
                height = v[p] - v[left]
                if height > 0:
                    amp.append(height)
                    half = min(v[left], v[right]) + (v[p] - min(v[left], v[right])) / 2
                    above = np.flatnonzero(v[left : right + 1] > half)
                    width.append((above[-1] - above[0]) / rate if len(above) else 0.0)
            amp, width = np.array(amp), np.array(width)
            m = _median(amp)
            low = max(0.35 * m, 0.5 * np.percentile(amp, 25)) if len(amp) else np.nan
            turn = np.abs(np.diff(amp))
            rows.append((len(amp), m, amp.std() / (m + 1e-8) if len(amp) else np.nan, m / (np.median(np.abs(v)) + 1e-8), (amp < low).mean() if len(amp) else np.nan, _median(width), np.median(turn[::2]) / (m + 1e-8) if len(turn) >= 4 else np.nan))
        n, *rest = (np.array(c, float) for c in zip(*rows, strict=True))
        names = ("amplitude", "amplitude_cv", "perfusion", "low_fraction", "half_width_s", "alternans")
        return {"pulses": n.astype(int)} | {k: _r(v) for k, v in zip(names, rest, strict=True)}

    return per_signal(signals, "pulses long, amplitude double, amplitude_cv double, perfusion double, low_fraction double, half_width_s double, alternans double", f)


def seismo_quality(signals: DataFrame, rate: float) -> DataFrame:
    """Shares of cardiac, motion and fast power and of flat seconds; any reason makes a signal bad."""

    def f(x):
        hz, p = dsp.welch(x, rate, int(4 * rate))
        band = lambda a, b: dsp.band_power(hz, p, a, min(b, 0.45 * rate)) if a < 0.45 * rate else np.zeros(len(x))
        total = band(0.08, 45) + 1e-12
        heart, motion, fast = band(0.8, 35) / total, band(0.08, 0.7) / total, band(35, 80) / total
        second = max(1, int(rate / 4) if x.shape[1] < 4 * rate else int(rate))
        part = x[:, : x.shape[1] // second * second].reshape(len(x), -1, second)
        flat = (part.std(axis=2) < 0.05 * x.std(axis=1, keepdims=True)).mean(axis=1)
        span = np.percentile(x, 95, axis=1) - np.percentile(x, 5, axis=1)
        reasons = np.stack([span < 0.1, flat > 0.1, motion > 0.55, fast > 0.3, heart < 0.25]).sum(axis=0)
        quality = np.select([reasons > 0, (heart < 0.45) | (motion > 0.35) | (fast > 0.18)], ["bad", "moderate"], "good")
        return {"cardiac": _r(heart), "motion": _r(motion), "fast": _r(fast), "flat": _r(flat), "reasons": reasons, "quality": quality.astype(object)}

    return per_signal(signals, "cardiac double, motion double, fast double, flat double, reasons long, quality string", f)


def heart_sounds(signals: DataFrame, rate: float) -> DataFrame:
    """Cycle length, rate, signal-to-noise of the envelope, share of fast power and a quality level."""

    def f(x):
        y = dsp.bandpass(x, rate, 25.0 if rate > 120 else 1.0, min(200.0, 0.45 * rate))
        env = dsp.envelope(y)
        env = env / np.maximum(np.percentile(env, 95, axis=1, keepdims=True), 1e-12)
        r = dsp.autocorrelation(env)
        lo, hi = max(1, int(0.33 * rate)), min(x.shape[1] - 1, int(1.6 * rate))
        lag = r[:, lo : hi + 1].argmax(axis=1) + lo
        periodic = r[np.arange(len(x)), lag]
        snr = 20 * np.log10(np.maximum(np.percentile(env, 90, axis=1), 1e-6) / np.maximum(np.percentile(env, 20, axis=1), 1e-6))
        hz, p = dsp.welch(x, rate, int(rate))
        fast = dsp.band_power(hz, p, 0.3 * rate, 0.5 * rate) / np.maximum(np.trapezoid(p, hz, axis=1), 1e-12)
        quality = np.select([(snr >= 12) & (periodic >= 0.3), (snr >= 6) | (periodic >= 0.15)], ["good", "usable"], "poor")
        return {"cycle_s": _r(lag / rate), "rate_bpm": _r(60 * rate / lag), "periodicity": _r(periodic), "snr_db": _r(snr), "fast_ratio": _r(fast), "quality": quality.astype(object)}

    return per_signal(signals, "cycle_s double, rate_bpm double, periodicity double, snr_db double, fast_ratio double, quality string", f)


def ecg_artifacts(signals: DataFrame, rate: float) -> DataFrame:
    """Saturation, flat steps, baseline wander, fast noise and mains share of an ECG, and a product of penalties."""

    def f(x):
        top = np.abs(x).max(axis=1, keepdims=True)
        sat = np.where(top[:, 0] > 0, (np.abs(x) >= 0.999 * top).mean(axis=1), 1.0)
        span = np.percentile(x, 95, axis=1) - np.percentile(x, 5, axis=1)
        flat = (np.abs(np.diff(x, axis=1)) <= np.maximum(1e-4 * span, 1e-8)[:, None]).mean(axis=1)
        hz, p = dsp.welch(x, rate, int(8 * rate))
        total = np.trapezoid(p, hz, axis=1) + 1e-12
        part = lambda a, b: p[:, (hz >= a) & (hz < b)].sum(axis=1) * (hz[1] - hz[0]) / total
        wander, fast, mains = part(0, 0.5), part(0.4 * rate, rate), np.maximum(part(49, 51), part(59, 61))
        sqi = np.ones(len(x))
        for bad, factor in ((sat > 0.05, 0.6), (flat > 0.2, 0.5), (wander > 0.4, 0.8), (fast > 0.35, 0.7), (mains > 0.25, 0.8), (span <= 1e-8, 0.1)):
            sqi = np.where(bad, sqi * factor, sqi)
        level = np.select([sqi >= 0.75, sqi >= 0.45], ["good", "moderate"], "bad")
        return {"saturation": _r(sat), "flat": _r(flat), "wander": _r(wander), "fast": _r(fast), "mains": _r(mains), "sqi": _r(sqi), "quality": level.astype(object)}

    return per_signal(signals, "saturation double, flat double, wander double, fast double, mains double, sqi double, quality string", f)


def st_features(signals: DataFrame, rate: float) -> DataFrame:
    """Levels after each R peak against the level before it: median ST deviation, T and R amplitude, and a flag."""

    def f(x):
        rows = []
        for v, peaks in zip(x, r_peak_lists(x, rate)[0], strict=True):
            base, st, t, amp = [], [], [], []
            for p in peaks:
                a, b = v[max(0, p - int(0.12 * rate)) : max(1, p - int(0.05 * rate))], v[p + int(0.08 * rate) : p + int(0.14 * rate) + 1]
                c = v[p + int(0.16 * rate) : p + int(0.4 * rate) + 1]
                if len(a) and len(b):
                    base.append(np.median(a))
                    st.append(np.median(b) - base[-1])
                    amp.append(v[p] - base[-1])
                    t.append(c[np.abs(c - base[-1]).argmax()] - base[-1] if len(c) else np.nan)
            rows.append((len(st), _median(np.array(st)), float(np.nanmedian(t)) if np.isfinite(t).any() else np.nan, _median(np.array(amp))))
        n, s, t, a = (np.array(c, float) for c in zip(*rows, strict=True))
        rel = np.abs(s) / np.maximum(np.abs(a), 1e-8)
        flag = np.select([np.isnan(s), rel > 0.25, rel > 0.12], ["unknown", "marked", "possible"], "none")
        return {"beats": n.astype(int), "st": _r(s), "t_wave": _r(t), "r_wave": _r(a), "st_flag": flag.astype(object)}

    return per_signal(signals, "beats long, st double, t_wave double, r_wave double, st_flag string", f)
