"""Brain, muscle, skin, breathing and motion analyses of signals as arrays, one row each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..functions import dsp
from .spectral import per_signal


def _r(x) -> np.ndarray:
    return np.round(np.array(x, float), 6)


def _runs(on: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], on.astype(int), [0]]))
    return [(a, b) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if b - a >= least]


def _rms(x: np.ndarray, width: int) -> np.ndarray:
    """Rolling RMS with a fixed divisor, zero-padded."""
    sums = np.cumsum(np.pad(x**2, ((0, 0), (width // 2 + 1, (width - 1) // 2))), axis=1)
    return np.sqrt(np.maximum((sums[:, width:] - sums[:, :-width]) / width, 0))


def _centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = x - np.median(x, axis=1, keepdims=True)
    return c, 1.4826 * np.median(np.abs(c), axis=1, keepdims=True) + 1e-8


def seizure_screen(signals: DataFrame, rate: float) -> DataFrame:
    """Rising edges beyond 6 robust deviations a minute, share of fast power, and a risk (over 12 a minute, or over 0.45)."""

    def f(x):
        c, s = _centred(x)
        on = (np.abs(c) > 6 * s).astype(int)
        spikes = (np.diff(on, axis=1, prepend=0) == 1).sum(axis=1)
        per_min = spikes / (x.shape[1] / rate / 60)
        hz, p = dsp.welch(x, rate, int(4 * rate))
        fast = dsp.band_power(hz, p, 13, min(45, 0.45 * rate)) / np.maximum(dsp.band_power(hz, p, 0.5, min(45, 0.45 * rate) + 1e-9), 1e-12)
        risk = np.where((per_min > 12) | (fast > 0.45), "possible", "none")
        return {"spikes": spikes, "spikes_per_min": _r(per_min), "fast_ratio": _r(fast), "risk": risk.astype(object)}

    return per_signal(signals, "spikes long, spikes_per_min double, fast_ratio double, risk string", f)


def drowsiness(signals: DataFrame, rate: float) -> DataFrame:
    """Theta over alpha (from 1.2) or slow share (from 0.55) hint at drowsiness."""

    def f(x):
        hz, p = dsp.welch(x, rate, int(4 * rate))
        d, t, a = (dsp.band_power(hz, p, *b) for b in ((0.5, 4), (4, 8), (8, 13)))
        total = np.maximum(dsp.band_power(hz, p, 0.5, min(45, 0.45 * rate) + 1e-9), 1e-12)
        ta, slow = t / (a + 1e-12), (t + d) / total
        return {"theta_alpha": _r(ta), "slow_ratio": _r(slow), "hint": np.where((ta > 1.2) | (slow > 0.55), "drowsy", "alert").astype(object)}

    return per_signal(signals, "theta_alpha double, slow_ratio double, hint string", f)


def brain_artifacts(signals: DataFrame, rate: float) -> DataFrame:
    """Shares beyond 8 robust deviations (flag over 0.01) and of 30 - 45 Hz power (flag over 0.35)."""

    def f(x):
        c, s = _centred(x)
        extreme = (np.abs(c) > 8 * s).mean(axis=1)
        hz, p = dsp.welch(c, rate, int(4 * rate))
        top = min(45, 0.45 * rate)
        at = (hz >= 30) & (hz <= top)
        fast = np.trapezoid(p[:, at], hz[at], axis=1) / (np.trapezoid(p, hz, axis=1) + 1e-12) if at.any() else np.zeros(len(x))
        n = (extreme > 0.01).astype(int) + (fast > 0.35)
        return {"extreme": _r(extreme), "fast_ratio": _r(fast), "level": np.array(["low", "moderate", "high"], object)[n]}

    return per_signal(signals, "extreme double, fast_ratio double, level string", f)


def muscle_bursts(signals: DataFrame, rate: float, seconds: float = 0.05) -> DataFrame:
    """Runs of the RMS envelope over median + 3 deviations of at least ``seconds``: count, active share, threshold."""

    def f(x):
        high = min(250.0, 0.45 * rate)
        y = dsp.bandpass(x, rate, 20.0, high) if high > 25 else x - np.median(x, axis=1, keepdims=True)
        env = _rms(y, max(1, int(seconds * rate)))
        thr = np.maximum(np.median(env, axis=1) + 3 * env.std(axis=1), 1e-8)
        runs = [_runs(e > t, max(1, int(seconds * rate))) for e, t in zip(env, thr, strict=True)]
        active = np.array([sum(b - a for a, b in r) for r in runs]) / x.shape[1]
        return {"bursts": np.array([len(r) for r in runs]), "active": _r(active), "threshold": _r(thr), "rms": _r(np.sqrt((y**2).mean(axis=1))), "mav": _r(np.abs(y).mean(axis=1))}

    return per_signal(signals, "bursts long, active double, threshold double, rms double, mav double", f)


def arousal(signals: DataFrame, rate: float) -> DataFrame:
    """Phasic peaks a minute above a rolling median, and a stress score of three tests."""

    def f(x):
        width = max(3, int(rate) // 2 * 2 + 1)
        wide = np.pad(x, ((0, 0), (width // 2, width // 2)))
        tonic = np.median(np.lib.stride_tricks.sliding_window_view(wide, width, axis=1), axis=2)
        phasic = x - tonic
        n = np.array([len(dsp.find_peaks(r, distance=max(1, int(rate)), prominence=max(0.75 * r.std(), 1e-8))) for r in phasic])
        per_min = n / (x.shape[1] / rate / 60)
        mean = x.mean(axis=1)
        ratio = phasic.std(axis=1) / (np.abs(mean) + 1e-8)
        score = (per_min > 6).astype(int) + (ratio > 0.08) + (np.median(tonic, axis=1) > 1.2 * mean)
        return {"peaks": n, "peaks_per_min": _r(per_min), "phasic_ratio": _r(np.minimum(ratio, 1e6)), "score": score, "level": np.where(score >= 2, "elevated", "low").astype(object)}

    return per_signal(signals, "peaks long, peaks_per_min double, phasic_ratio double, score long, level string", f)


def breathing(signals: DataFrame, rate: float) -> DataFrame:
    """Breath peaks of 0.05 - 0.7 Hz: rate, variation of gaps and heights, share of breaths out of pairs, and pattern flags."""

    def f(x):
        y = dsp.bandpass(x, rate, 0.05, 0.7)
        rows = []
        for v in y:
            least = max(1, int(round(1.5 * rate)))
            need = max(0.2 * v.std(), 1e-8)
            up, down = dsp.find_peaks(v, distance=least, prominence=need), dsp.find_peaks(-v, distance=least, prominence=need)
            gap = np.diff(up) / rate
            gap = gap[(gap >= 1.0) & (gap <= 15.0)]
            alone = [not ((down > a) & (down < b)).any() for a, b in zip(up, [*up[1:], len(v)], strict=True)]
            bpm = 60 / np.median(gap) if len(gap) else np.nan
            cv, acv = gap.std() / gap.mean() if len(gap) > 1 else np.nan, v[up].std() / (np.abs(v[up]).mean() + 1e-8) if len(up) else np.nan
            flags = [name for test, name in ((bpm < 8, "slow"), (bpm > 24, "fast"), (cv > 0.35, "irregular"), (acv > 0.8, "variable")) if test]
            rows.append((len(up), bpm, cv, acv, np.mean(alone) if len(up) else np.nan, ",".join(flags)))
        n, bpm, cv, acv, alone, flags = zip(*rows, strict=True)
        return {"breaths": np.array(n), "rate_bpm": _r(bpm), "gap_cv": _r(cv), "height_cv": _r(acv), "unpaired": _r(alone), "flags": np.array(flags, object)}

    return per_signal(signals, "breaths long, rate_bpm double, gap_cv double, height_cv double, unpaired double, flags string", f)


def breath_events(signals: DataFrame, rate: float, seconds: float = 10.0) -> DataFrame:
    """Apneas (envelope below a quarter of its median) and hypopneas (0.25 - 0.70 of its upper quartile) of at least ``seconds``."""

    def f(x):
        env = _rms(dsp.bandpass(x, rate, 0.05, 0.7), max(1, int(2 * rate)))
        mid, upper = np.median(env, axis=1), np.percentile(env, 75, axis=1)
        least = max(1, int(seconds * rate))
        apnea = [_runs(e < 0.25 * m, least) for e, m in zip(env, mid, strict=True)]
        hypo = [_runs((e < 0.7 * u) & (e >= 0.25 * u), least) for e, u in zip(env, upper, strict=True)]
        hours = x.shape[1] / rate / 3600
        count = lambda r: np.array([len(k) for k in r])
        longest = [max((b - a for a, b in r), default=0) / rate for r in apnea]
        return {"apneas": count(apnea), "hypopneas": count(hypo), "events_per_hour": _r((count(apnea) + count(hypo)) / hours), "longest_apnea_s": _r(longest)}

    return per_signal(signals, "apneas long, hypopneas long, events_per_hour double, longest_apnea_s double", f)


def motion_summary(signals: DataFrame, rate: float) -> DataFrame:
    """Deviation, range and 95th percentile of jerk of a magnitude in g, and an activity level."""

    def f(x):
        level = np.median(np.abs(x), axis=1, keepdims=True)
        g = x / np.where(level > 5, 9.80665, np.where(level > 0.5, 1.0, np.maximum(level, 1e-8)))
        sd, jerk = g.std(axis=1), np.percentile(np.abs(np.diff(g, axis=1, prepend=g[:, :1])) * rate, 95, axis=1)
        span = np.percentile(g, 95, axis=1) - np.percentile(g, 5, axis=1)
        name = np.select([(sd > 0.35) | (jerk > 3), (sd > 0.08) | (jerk > 0.8)], ["high", "moderate"], "low")
        return {"sd": _r(sd), "span": _r(span), "jerk_p95": _r(jerk), "activity": name.astype(object)}

    return per_signal(signals, "sd double, span double, jerk_p95 double, activity string", f)


def impacts(signals: DataFrame, rate: float) -> DataFrame:
    """Impacts at least a second apart, those with quiet after them, and a fall level."""

    def f(x):
        level = np.median(np.abs(x), axis=1, keepdims=True)
        g = x / np.where(level > 5, 9.80665, np.where(level > 0.5, 1.0, np.maximum(level, 1e-8)))
        dyn = g - np.median(g, axis=1, keepdims=True)
        adaptive = np.maximum.reduce([0.85 * np.percentile(np.abs(dyn), 99, axis=1), 3.5 * dyn.std(axis=1), np.full(len(x), 0.45)])
        quiet, n, calm = max(3, int(0.4 * rate)), [], []
        for d, a in zip(dyn, adaptive, strict=True):
            last, events, still = -(10**9), 0, 0
            for i in np.flatnonzero(np.abs(d) >= a):
                if i - last >= max(1, int(rate)):
                    last, events = i, events + 1
                    after = d[i : i + int(1.5 * rate)]
                    still += len(after) >= quiet and after[-quiet:].std() < 0.12
            n.append(events)
            calm.append(still)
        n, calm = np.array(n), np.array(calm)
        return {"impacts": n, "fall_like": calm, "threshold_g": _r(adaptive), "level": np.select([calm > 0, n > 0], ["fall_pattern", "possible"], "none").astype(object)}

    return per_signal(signals, "impacts long, fall_like long, threshold_g double, level string", f)
