"""Waves of electrocardiograms from the signal: onsets, peaks and offsets by a spline wavelet on several scales."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6
from .beat_detection import r_peak_lists
from .spectral import per_signal

#: The quadratic spline's smoothing and its slope filter (fixed values).
SMOOTH = (0.125, 0.375, 0.375, 0.125)
SLOPE = (2.0, -2.0)
#: By wave: scale, how far its slopes fall at onset and offset, and the least height of its steepest slope against that of the QRS.
RULES = {"qrs": (2, 0.05, 0.06, 0.0), "p": (3, 0.22, 0.22, 0.02), "t": (3, 0.18, 0.18, 0.02)}
WAVES = ("p_on", "p_peak", "p_off", "qrs_on", "r_peak", "qrs_off", "t_on", "t_peak", "t_off")


def scales(x: np.ndarray, rate: float, many: int = 4) -> np.ndarray:
    """Undecimated wavelet transform of each row: (scale, row, sample), each scale moved back by its delay.

    At 250 samples a second scale k sees slopes over 2^k samples; at other rates the holes between the
    taps are as long in seconds.
    """
    step, out = rate / 250.0, []

    def spread(v: np.ndarray, taps: tuple[float, ...], hole: int) -> np.ndarray:
        wide = np.pad(v, ((0, 0), (hole * (len(taps) - 1), 0)), mode="edge")
        n = v.shape[1]
        return sum(c * wide[:, hole * (len(taps) - 1 - k) : hole * (len(taps) - 1 - k) + n] for k, c in enumerate(taps))

    smooth, delay = x, 0.0
    for k in range(many):
        hole = max(1, round(2**k * step))
        w = spread(smooth, SLOPE, hole)
        back = round(delay + hole / 2)
        out.append(np.concatenate([w[:, back:], np.repeat(w[:, -1:], back, axis=1)], axis=1))
        smooth = spread(smooth, SMOOTH, hole)
        delay += 1.5 * hole
    return np.stack(out)


def _extremes(w: np.ndarray, a: int, z: int) -> np.ndarray:
    """Places within [a, z) where the modulus has a maximum."""
    m = np.abs(w[a:z])
    if len(m) < 3:
        return np.zeros(0, int)
    return a + 1 + np.flatnonzero((m[1:-1] >= m[:-2]) & (m[1:-1] > m[2:]))


def _walk(w: np.ndarray, at: int, step: int, share: float, stop: int) -> int:
    """From a steepest place outwards to where the slope is below a share of it, or turns up again."""
    limit = share * abs(w[at])
    while at != stop and 0 < at < len(w) - 1:
        after = abs(w[at + step])
        if after < limit or (after > abs(w[at]) and abs(w[at]) < 3 * limit):
            return at + step if after < limit else at
        at += step
    return at


def _wave(w: np.ndarray, a: int, z: int, on: float, off: float, least: float) -> tuple[int, int, int] | None:
    """Onset, peak and offset of the wave within [a, z): two steepest places of unlike sign with the peak at the zero between them."""
    tops = _extremes(w, a, z)
    if not len(tops):
        return None
    size = np.abs(w[tops])
    tops = tops[size >= max(least, 0.3 * size.max())]
    pairs = [(p, q) for p, q in zip(tops[:-1], tops[1:], strict=True) if w[p] * w[q] < 0]
    if not pairs:
        return None
    p, q = max(pairs, key=lambda t: abs(w[t[0]]) + abs(w[t[1]]))
    turn = p + int(np.flatnonzero(w[p : q + 1] * w[p] <= 0)[0])
    peak = turn if abs(w[turn]) <= abs(w[turn - 1]) else turn - 1
    return _walk(w, p, -1, on, a), int(peak), _walk(w, q, 1, off, z - 1)


def delineate_row(w: np.ndarray, peaks: np.ndarray, rate: float) -> list[dict[str, int | None]]:
    """The waves of each beat of one signal, from its scales; places of waves that are not there are None."""
    out, n, beats = [], w.shape[1], peaks.tolist()
    s = lambda seconds: int(round(seconds * rate))
    for k, r in enumerate(beats):
        beat: dict[str, int | None] = dict.fromkeys(WAVES)
        beat["r_peak"] = r
        scale, on, off, _ = RULES["qrs"]
        q = w[scale - 1]
        tops = _extremes(q, max(0, r - s(0.09)), min(n, r + s(0.11)))
        if not len(tops):
            out.append(beat)
            continue
        steep = np.abs(q[tops]).max()
        before = tops[(tops < r) & (np.abs(q[tops]) >= 0.09 * steep)]
        after = tops[(tops > r) & (np.abs(q[tops]) >= 0.09 * steep)]
        beat["qrs_on"] = _walk(q, before[0], -1, on * steep / abs(q[before[0]]), max(0, r - s(0.13))) if len(before) else None
        beat["qrs_off"] = _walk(q, after[-1], 1, off * steep / abs(q[after[-1]]), min(n - 1, r + s(0.16))) if len(after) else None
        start = beat["qrs_on"] if beat["qrs_on"] is not None else r - s(0.05)
        end = beat["qrs_off"] if beat["qrs_off"] is not None else r + s(0.06)
        gap = beats[k + 1] - r if k + 1 < len(beats) else r - beats[k - 1] if k else s(0.8)
        last = r - beats[k - 1] if k else gap
        for name, a, z in (("t", end + s(0.03), min(n, r + min(s(0.55), int(0.65 * gap)))), ("p", max(0, r - min(s(0.3), int(0.4 * last))), start - s(0.005))):
            scale, on, off, least = RULES[name]
            if found := _wave(w[scale - 1], a, z, on, off, least * np.abs(w[scale - 1][max(0, r - s(0.1)) : r + s(0.1)]).max()):
                beat |= dict(zip((f"{name}_on", f"{name}_peak", f"{name}_off"), found, strict=True))
        out.append(beat)
    return out


def delineate(signals: DataFrame, rate: float) -> DataFrame:
    """P, QRS and T waves of electrocardiograms (record, values): record, beat (from 1), and the sample of each onset, peak and offset.

    Slopes are a quadratic spline wavelet on scales of 2 to 16 samples (at 250 a second), for all
    signals of a batch at once; R peaks are those of ``r_peaks``.  The complex is read on scale
    2, P and T on scale 3: steepest places, the zero between two of unlike sign, and outwards to where
    the slope has fallen.  Waves that are not there are null; null or broken signals have no rows.
    """

    def f(x):
        peaks, _, _ = r_peak_lists(x, rate)
        w = scales(x, rate)
        rows = [delineate_row(w[:, k], peaks[k], rate) for k in range(len(x))]
        out = {}
        for name in WAVES:
            column = np.empty(len(x), object)
            column[:] = [[b[name] for b in beats] for beats in rows]
            out[name] = column
        return out

    wide = per_signal(signals, ", ".join(f"{n} array<long>" for n in WAVES), f)
    beats = wide.select("record", F.posexplode(F.arrays_zip(*WAVES)).alias("k", "b"))
    return beats.select("record", (F.col("k") + 1).cast("long").alias("beat"), *[F.col(f"b.{n}").cast("long").alias(n) for n in WAVES])


def wave_durations(waves: DataFrame, rate: float) -> DataFrame:
    """Median durations in seconds by record: P, PR, QRS, QT, and how many beats have each wave."""
    span = lambda a, z: (F.col(z) - F.col(a)) / F.lit(float(rate))
    figures = {"p_s": ("p_on", "p_off"), "pr_s": ("p_on", "qrs_on"), "qrs_s": ("qrs_on", "qrs_off"), "qt_s": ("qrs_on", "t_off")}
    return waves.groupBy("record").agg(
        F.count("*").alias("beats"), F.count("p_peak").alias("p_waves"), F.count("t_peak").alias("t_waves"), *[r6(F.median(span(*v))).alias(k) for k, v in figures.items()]
    )
