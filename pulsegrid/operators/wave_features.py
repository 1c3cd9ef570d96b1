"""Feature vectors and event detectors of whole signals: arrays, one row each, in Arrow batches."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import dsp
from .spectral import per_signal


def _r(x) -> np.ndarray:
    return np.round(np.array(x, float), 6)


def _spread(x: np.ndarray) -> float:
    return float(1.4826 * np.median(np.abs(x - np.median(x))) or x.std())


def multiscale_peaks(y: np.ndarray, rate: float, slowest: float = 35.0, fastest: float = 220.0) -> tuple[np.ndarray, np.ndarray, int]:
    """Systolic peaks of a filtered pulse wave that several smoothing widths agree on: places, heights above the trough nearby, long gaps.

    Each of four widths votes around its own peaks; where 2.2 votes or more meet, the highest
    sample within 0.08 s is a peak if it stands out.  Of peaks too close to each other the higher stays.
    """
    apart, scales = max(1, int(60 / fastest * rate)), (0.04, 0.08, 0.12, 0.18)
    base, votes = max(_spread(y), 1e-8), np.zeros(len(y))
    for seconds in scales:
        width = max(1, int(seconds * rate))
        smooth = np.convolve(y, np.full(width, 1 / width), "same")
        for p in dsp.find_peaks(smooth, distance=apart, prominence=max(0.35 * _spread(smooth), 0.12 * base, 1e-8)):
            votes[max(0, p - max(1, width // 2)) : p + max(1, width // 2) + 1] += 1
    near, around = max(1, int(0.08 * rate)), max(1, int(0.32 * rate))
    found: list[int] = []
    for p in dsp.find_peaks(votes, height=max(2.0, 0.55 * len(scales)), distance=apart):
        a = max(0, p - near)
        top = a + int(y[a : p + near + 1].argmax())
        if y[top] - y[max(0, top - around) : top + around + 1].min() < max(0.3 * base, 1e-8):
            continue
        if found and top - found[-1] < apart:
            found[-1] = max(found[-1], top, key=lambda i: y[i])
        else:
            found.append(top)
    peaks = np.array(sorted(set(found)), int)
    height = np.array([y[p] - y[max(0, p - around) : p + around + 1].min() for p in peaks])
    return peaks, height, int((np.diff(peaks) > 60 / slowest * rate).sum())


def pulse_votes(signals: DataFrame, rate: float) -> DataFrame:
    """Peaks by ``multiscale_peaks``, their rate, height and long gaps."""

    def f(x):
        rows = []
        for y in dsp.bandpass(x, rate, 0.4, min(8.0, 0.45 * rate)):
            p, h, gaps = multiscale_peaks(y - np.median(y), rate)
            rows.append((len(p), 60 * rate / np.median(np.diff(p)) if len(p) > 1 else np.nan, np.median(h) if len(h) else np.nan, gaps))
        n, bpm, h, gaps = (np.array(c, float) for c in zip(*rows, strict=True))
        return {"peaks": n.astype(int), "rate_bpm": _r(bpm), "height": _r(h), "long_gaps": gaps.astype(int)}

    return per_signal(signals, "peaks long, rate_bpm double, height double, long_gaps long", f)


#: Bins of breathing rates, breaths a minute.
RATE_BIN = 1.875


def breathing_peaks(x: np.ndarray, rate: float, low: float = 0.08, high: float = 0.7) -> list[list[tuple[float, float]]]:
    """For each row of x the eight strongest rates a minute of the breathing band and their power against the mean of the band.

    A rate below 8 gives way to a double or triple of 9 to 24 that has enough of its power.  All rows are filtered at once.
    """
    y = dsp.bandpass(x, rate, low, min(high, 0.45 * rate))
    hz, p = dsp.welch(y, rate, int(32 * rate))
    at = (hz >= low) & (hz <= min(high, 0.45 * rate))
    if not at.any():
        return [[] for _ in x]
    hz, p = 60 * hz[at], np.ascontiguousarray(p[:, at])
    p = p / (p.mean(axis=1, keepdims=True) + 1e-12)
    best = np.argsort(p, axis=1, kind="stable")[:, ::-1][:, :8]
    found = [list(zip(*row, strict=True)) for row in zip(hz[best].tolist(), np.take_along_axis(p, best, axis=1).tolist(), strict=True)]
    for top in found:
        first = top[0][0]
        if first < 8:
            for i, (bpm, power) in enumerate(top[1:], 1):
                if 9 <= bpm <= 24 and min(abs(bpm - 2 * first), abs(bpm - 3 * first)) <= 1.5 and power >= max(1.5, 0.25 * top[0][1]):
                    top.insert(0, top.pop(i))
                    break
    return found


def choose_breathing(found: dict[str, list[tuple[float, float]]]) -> tuple[float, str, float]:
    """Rate, source and power from the candidates of each source, in the order baseline, envelope, amplitude, interval.

    The baseline counts where another source is within 3 of it or where it is strong, else the
    strongest source.  A rate of at most 11.5 is raised to a bin between 13 and 22.5 that two
    sources support with a score of 3, its double before others, unless two sources speak as
    clearly for the slow one.
    """
    first = {s: c[0] for s, c in found.items() if c}
    if not first:
        return np.nan, "none", 0.0
    source = max(first, key=lambda s: first[s][1])
    if "baseline" in first:
        slow = first["baseline"][0]
        if any(s in first and abs(first[s][0] - slow) <= 3 for s in ("amplitude", "envelope")) or first["baseline"][1] >= 2.5:
            source = "baseline"
    bpm, power = first[source]
    if bpm > 11.5:
        return bpm, source, power
    score, sources = defaultdict(float), defaultdict(set)
    slow_score, slow_sources, slow_tops = 0.0, set(), 0
    for s, peaks in found.items():
        for k, (v, p) in enumerate(peaks):
            if 13 <= v <= 22.5 and abs(v - bpm) >= 3:
                score[round(v / RATE_BIN)] += p * 0.9**k
                if p >= 1.3:
                    sources[round(v / RATE_BIN)].add(s)
            if k < 4 and abs(v - bpm) <= 1:
                slow_score += p * 0.9**k
                slow_tops += k <= 1
                if p >= 1.45:
                    slow_sources.add(s)
    good = [b for b in score if len(sources[b]) >= 2 and score[b] >= 3]
    double = round(2 * bpm / RATE_BIN)
    if good:
        best = double if double in good else max(good, key=lambda b: (len(sources[b]), score[b]))
        if not (len(slow_sources) >= 2 and slow_tops >= 2 and slow_score >= 1.35 * score[best]):
            return best * RATE_BIN, "harmonic", score[best]
    return bpm, source, power


def pulse_respiration(signals: DataFrame, rate: float) -> DataFrame:
    """Breaths a minute in a pulse wave, from its baseline, its envelope, and the heights and gaps of its peaks."""

    def f(x):
        heart = dsp.bandpass(x, rate, 0.4, min(8.0, 0.45 * rate))
        envelope = dsp.envelope(x - np.median(x, axis=1, keepdims=True))
        found = [{"baseline": b, "envelope": e} for b, e in zip(breathing_peaks(x, rate), breathing_peaks(envelope, rate), strict=True)]
        peaks = {i: p for i, y in enumerate(heart) if len(p := multiscale_peaks(y - np.median(y), rate)[0]) >= 5}
        if peaks:
            t = np.arange(x.shape[1])
            heights = np.array([np.interp(t, p, x[i, p]) for i, p in peaks.items()])
            gaps = np.array([np.interp(t, p[1:], np.diff(p) / rate) for p in peaks.values()])
            for i, a, g in zip(peaks, breathing_peaks(heights, rate), breathing_peaks(gaps, rate), strict=True):
                found[i] |= {"amplitude": a, "interval": g}
        rows = [choose_breathing(c) for c in found]
        bpm, source, power = zip(*rows, strict=True)
        return {"rate_bpm": _r(bpm), "source": np.array(source, object), "power": _r(power)}

    return per_signal(signals, "rate_bpm double, source string, power double", f)


def sound_cycles(env: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, float]:
    """S1 and S2 places in an envelope, by its cycle: the phase with most sound at S1 and at S2 after 0.32 of a cycle."""
    r = dsp.autocorrelation(env[None, :])[0]
    lo, hi = max(1, int(0.45 * rate)), min(len(env) - 1, int(1.4 * rate))
    if hi <= lo:
        return np.zeros(0, int), np.zeros(0, int), 0.0
    cycle = lo + int(r[lo : hi + 1].argmax())
    delay = int(round(np.clip(0.32 * cycle / rate, 0.18, 0.45) * rate))
    reach = max(1, int(0.06 * rate))
    top = np.array([env[max(0, i - reach) : i + reach + 1].max() for i in range(len(env))])
    score = [np.mean([w * top[i + d] for i in range(k, len(env), cycle) for d, w in ((0, 1.0), (delay, 0.85)) if i + d < len(env)]) for k in range(cycle)]
    reach = max(1, int(0.08 * rate))
    at = lambda i: max(0, i - reach) + int(env[max(0, i - reach) : i + reach + 1].argmax())
    starts = range(int(np.argmax(score)), len(env), cycle)
    return np.unique([at(i) for i in starts]), np.unique([at(i + delay) for i in starts if i + delay < len(env)]), cycle / rate


def _bands(x: np.ndarray, rate: float, edges: tuple[float, ...]) -> np.ndarray:
    """Shares of power between the edges."""
    if len(x) < 16:
        return np.zeros(len(edges) - 1)
    hz, p = dsp.welch(x[None, :], rate, int(2 * rate))
    power = np.array([p[0, (hz >= a) & (hz < b)].sum() for a, b in zip(edges[:-1], edges[1:], strict=True)])
    return power / (power.sum() + 1e-12)


def murmur_features(signals: DataFrame, rate: float, edges: tuple[float, ...]) -> DataFrame:
    """Shares of fast power (the upper half of the bands) and of loud samples in systole and diastole, scores from both, and when sound prevails."""

    def f(x):
        y = dsp.bandpass(x, rate, edges[0], edges[-1])
        env, rows = dsp.envelope(y), []
        for v, e in zip(y, env, strict=True):
            s1, s2, cycle = sound_cycles(e, rate)
            loud, parts = e > np.percentile(e, 65), {"sys": [], "dia": []}
            for a in s1:
                b, c = s2[s2 > a], s1[s1 > a]
                if len(b) and (not len(c) or b[0] < c[0]):
                    parts["sys"].append((a, b[0]))
                    if len(c):
                        parts["dia"].append((b[0], c[0]))
            out = []
            for gain, spans in ((1.5, parts["sys"]), (1.7, parts["dia"])):
                long = [v[a:b] for a, b in spans if b - a >= 4]
                share = _bands(np.concatenate(long), rate, edges) if long else np.zeros(len(edges) - 1)
                fast, keeps = float(share[len(share) // 2 :].sum()), float(np.median([loud[a:b].mean() for a, b in spans])) if spans else 0.0
                out += [fast, keeps, min(1.0, gain * fast + 0.8 * keeps)]
            when = "diastolic" if out[5] > out[2] + 0.12 else "systolic" if out[2] > out[5] + 0.12 else "mixed"
            rows.append((len(s1), cycle, *out, when))
        n, *rest, when = zip(*rows, strict=True)
        names = ("cycle_s", "systolic_fast", "systolic_loud", "systolic_score", "diastolic_fast", "diastolic_loud", "diastolic_score")
        return {"cycles": np.array(n)} | {k: _r(c) for k, c in zip(names, rest, strict=True)} | {"timing": np.array(when, object)}

    schema = "cycles long, cycle_s double, systolic_fast double, systolic_loud double, systolic_score double, diastolic_fast double, diastolic_loud double, diastolic_score double, timing string"
    return per_signal(signals, schema, f)


def spectrum_features(signals: DataFrame, rate: float, edges: tuple[float, ...]) -> DataFrame:
    """Of each signal: RMS, crest, median, mean and strongest frequency, entropy, shares of the bands between ``edges``, and how the envelope varies."""
    names = [f"band_{i}" for i in range(len(edges) - 1)]

    def f(x):
        x = x - np.median(x, axis=1, keepdims=True)
        hz, p = dsp.welch(x, rate, min(x.shape[1], int(2 * rate)))
        total = p.sum(axis=1, keepdims=True) + 1e-12
        q = p / total
        c = np.cumsum(p, axis=1)
        e = dsp.envelope(x)
        rms = np.sqrt((x**2).mean(axis=1) + 1e-12)
        out = {
            "rms": rms, "crest": np.abs(x).max(axis=1) / rms, "median_hz": hz[(c >= c[:, -1:] / 2).argmax(axis=1)], "mean_hz": q @ hz, "peak_hz": hz[p.argmax(axis=1)],
            "entropy": -(q * np.log2(q + 1e-12)).sum(axis=1) / np.log2(q.shape[1]), "envelope_cv": e.std(axis=1) / (e.mean(axis=1) + 1e-12), "envelope_p95": np.percentile(e, 95, axis=1) / (np.median(e, axis=1) + 1e-12),
        }
        power = np.stack([p[:, (hz >= a) & (hz < b)].sum(axis=1) for a, b in zip(edges[:-1], edges[1:], strict=True)], axis=1)
        share = power / (power.sum(axis=1, keepdims=True) + 1e-12)
        return {k: _r(v) for k, v in out.items()} | {n: _r(share[:, i]) for i, n in enumerate(names)}

    fields = ("rms", "crest", "median_hz", "mean_hz", "peak_hz", "entropy", "envelope_cv", "envelope_p95", *names)
    return per_signal(signals, ", ".join(f"{n} double" for n in fields), f)


def breathing_features(signals: DataFrame, rate: float) -> DataFrame:
    """Of breathing signals: how much of the time the envelope is below a quarter, between a quarter and 0.7, and below half of its upper quartile; breaths and the variation of their gaps."""

    def f(x):
        y, rows = dsp.bandpass(x, rate, 0.05, 0.7), []
        width = max(1, int(2 * rate))
        for v in y:
            e = np.sqrt(np.convolve(v * v, np.full(width, 1 / width), "same"))
            base = np.percentile(e, 75) + 1e-12
            p = dsp.find_peaks(v, distance=max(1, int(1.5 * rate)), prominence=max(0.2 * v.std(), 1e-8))
            gap = np.diff(p) / rate
            gap = gap[(gap >= 1) & (gap <= 15)]
            rows.append((len(p), 60 / np.median(gap) if len(gap) else np.nan, gap.std() / gap.mean() if len(gap) else np.nan, (e < 0.25 * base).mean(), ((e >= 0.25 * base) & (e < 0.7 * base)).mean(), (e < 0.5 * base).mean()))
        n, *rest = (np.array(c, float) for c in zip(*rows, strict=True))
        return {"breaths": n.astype(int)} | {k: _r(c) for k, c in zip(("rate_bpm", "gap_cv", "still", "reduced", "below_half"), rest, strict=True)}

    return per_signal(signals, "breaths long, rate_bpm double, gap_cv double, still double, reduced double, below_half double", f)


def fragment_trace(masks: DataFrame) -> DataFrame:
    """The median trace of the longest connected fragment of marked pixels (image, x, y): pixels that touch by a side belong together.

    A fragment counts by its width times the root of its area over that of its height; the first by
    its first pixel of equals.  Pixels are made distinct first, so an image is bounded by its size.
    """

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        left = set(zip(pdf.x, pdf.y, strict=True))
        best: tuple[float, list] = (-1.0, [])
        for seed in sorted(left):
            if seed not in left:
                continue
            left.discard(seed)
            part, todo = [], [seed]
            while todo:
                x, y = todo.pop()
                part.append((x, y))
                for q in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
                    if q in left:
                        left.discard(q)
                        todo.append(q)
            xs, ys = zip(*part, strict=True)
            score = (max(xs) - min(xs) + 1) * np.sqrt(len(part)) / np.sqrt(max(ys) - min(ys) + 1)
            best = max(best, (score, part), key=lambda b: b[0])
        rows = pd.DataFrame(best[1], columns=["x", "y"]).groupby("x").y.median().reset_index()
        return pd.DataFrame({"image": pdf.image.iloc[0], "x": rows.x, "y": rows.y.astype(float)})

    return masks.select("image", "x", "y").distinct().groupBy("image").applyInPandas(trace, "image long, x long, y double")
