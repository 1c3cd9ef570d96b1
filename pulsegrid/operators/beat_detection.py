"""Beats found in the signal itself: R peaks by running thresholds, and heart sounds by phase and durations.

Signals are rows with an array, so nothing is shuffled.  Filters, envelopes and the search over
phases run on all signals of a batch at once; only the thresholds go from peak to peak.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..functions import dsp
from .spectral import _r, per_signal

#: Running levels keep this part of what they were; a missed beat is looked for after so many mean intervals.
KEEP = 0.875
MISSED = 1.66
REFRACTORY_S = 0.2
T_WAVE_S = 0.36


def _lists(rows: list) -> np.ndarray:
    out = np.empty(len(rows), object)
    out[:] = [np.asarray(r, int).tolist() for r in rows]
    return out


def running_mean(x: np.ndarray, width: int) -> np.ndarray:
    """The mean of each sample and those around it, ``width`` in all, zero beyond the ends."""
    c = np.cumsum(np.pad(x, ((0, 0), (width // 2 + 1, width - width // 2 - 1))), axis=1)
    return (c[:, width:] - c[:, :-width]) / width


def adaptive_beats(energy: np.ndarray, slope: np.ndarray, rate: float) -> tuple[list[int], int]:
    """Peaks of the energy of one signal that are beats, and how many of them were found by searching back.

    A signal level and a noise level follow the peaks; the threshold is a quarter of the way
    from noise to signal.  A peak above it is a beat unless a beat is less than 200 ms away (the
    higher stays) or it follows one within 360 ms with less than half its slope (a T wave).
    When no beat comes for 1.66 mean intervals, the highest peak in between is one if it
    exceeds half the threshold as an amplitude (a quarter of its energy) and twice the noise.
    """
    peaks = dsp.find_peaks(energy, distance=max(1, int(REFRACTORY_S * rate)))
    if not len(peaks):
        return [], 0
    first = energy[: max(1, int(2 * rate))]
    signal, noise = 0.5 * first.max(), 0.5 * first.mean()
    near = max(1, int(0.075 * rate))
    steep = [slope[max(0, p - near) : p + near + 1].max() for p in peaks]
    beats: list[int] = []  # places in ``peaks``
    gaps: list[float] = []
    found, k = 0, 0

    def take(i: int, keep: float) -> None:
        nonlocal signal
        if beats:
            gaps.append(peaks[i] - peaks[beats[-1]])
        beats.append(i)
        signal = keep * signal + (1 - keep) * energy[peaks[i]]

    while k < len(peaks):
        threshold = noise + 0.25 * (signal - noise)
        mean_gap = np.mean(gaps[-8:]) if gaps else None
        if mean_gap and peaks[k] - peaks[beats[-1]] > MISSED * mean_gap:
            between = [i for i in range(beats[-1] + 1, k) if energy[peaks[i]] > max(0.25 * threshold, 2 * noise) and peaks[i] - peaks[beats[-1]] >= T_WAVE_S * rate]
            if between:
                take(max(between, key=lambda i: energy[peaks[i]]), 0.75)
                found += 1
                continue
        e = energy[peaks[k]]
        since = (peaks[k] - peaks[beats[-1]]) / rate if beats else np.inf
        if e <= threshold or (since < T_WAVE_S and steep[k] < 0.5 * steep[beats[-1]]):
            noise = KEEP * noise + (1 - KEEP) * e
        elif since < REFRACTORY_S:
            if e > energy[peaks[beats[-1]]]:
                beats[-1] = k
        else:
            take(k, KEEP)
        k += 1
    return [int(peaks[i]) for i in beats], found


def plausible(peaks: np.ndarray, rate: float, n: int) -> bool:
    """Two beats at least, with a median rate and a count that are both 35 to 220 a minute."""
    if len(peaks) < 2:
        return False
    return 35 <= 60 * rate / np.median(np.diff(peaks)) <= 220 and 35 <= 60 * rate * len(peaks) / n <= 220


def r_peak_lists(x: np.ndarray, rate: float) -> tuple[list[np.ndarray], list[int], list[str]]:
    """For each row: R peaks, beats found by searching back, and the method that gave the peaks."""
    y = dsp.bandpass(x, rate, 5.0, 15.0, 2)
    slope = np.abs(np.gradient(y, axis=1))
    energy = running_mean(slope**2, max(1, int(0.15 * rate)))
    half, near, out, back, method = max(1, int(0.1 * rate)), max(1, int(0.04 * rate)), [], [], []

    def tip(row: int, p: int) -> int:
        """The largest deflection of the signal from its level around, beside the largest of the filtered signal."""
        a = max(0, p - half)
        level = np.median(x[row, a : p + half + 1])
        a += int(np.abs(y[row, a : p + half + 1]).argmax())
        return max(0, a - near) + int(np.abs(x[row, max(0, a - near) : a + near + 1] - level).argmax())

    for row in range(len(x)):
        peaks, found = adaptive_beats(energy[row], slope[row], rate)
        way = "adaptive"
        if not plausible(np.array(peaks), rate, x.shape[1]):
            e = np.abs(y[row])
            peaks, found, way = dsp.find_peaks(e, np.percentile(e, 95), max(1, round(0.36 * rate))), 0, "fallback"
        out.append(np.array(sorted({tip(row, p) for p in peaks}), int))
        back.append(found)
        method.append(way)
    return out, back, method


def r_peaks(signals: DataFrame, rate: float) -> DataFrame:
    """R peaks of electrocardiograms (record, values): their indices, count, rate, and how sure that is.

    Band-pass 5 to 15 Hz, slope, square, mean over 150 ms, then running thresholds with search
    back.  Where that gives no plausible rhythm, peaks of the filtered signal above
    its 95th percentile are taken (``fallback``).  Each beat is the largest deflection within
    40 ms of the filtered signal's.  Confidence is 0.82, by fallback 0.65, and 0.3 where the rate is not 35 to 220.
    Signals that are null, shorter than 16 samples or hold missing samples get nulls.
    """

    def f(x):
        peaks, back, method = r_peak_lists(x, rate)
        bpm = np.array([60 * rate / np.median(np.diff(p)) if len(p) > 1 else np.nan for p in peaks])
        sure = np.where((bpm >= 35) & (bpm <= 220), np.where(np.array(method) == "adaptive", 0.82, 0.65), 0.3)
        return {"peaks": _lists(peaks), "beats": np.array([len(p) for p in peaks]), "heart_rate_bpm": _r(bpm), "searched_back": np.array(back), "method": np.array(method, object), "confidence": sure}

    return per_signal(signals, "peaks array<long>, beats long, heart_rate_bpm double, searched_back long, method string, confidence double", f)


def sound_envelope(x: np.ndarray, rate: float, high: float = 220.0) -> np.ndarray:
    """Envelope of band-passed heart sounds, median-smoothed over 50 ms, as multiples of its 95th percentile up to 5."""
    high = min(high, 0.45 * rate)
    low = 20.0 if high > 45 else max(1.0, 0.05 * rate)
    e = dsp.envelope(dsp.bandpass(x, rate, low, high) if high > low else x - np.median(x, axis=1, keepdims=True))
    width = max(3, round(0.05 * rate)) | 1
    if x.shape[1] >= width:
        e = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(e, ((0, 0), (width // 2, width // 2))), width, axis=1), axis=2)
    return np.clip(e / (np.percentile(e, 95, axis=1, keepdims=True) + 1e-12), 0, 5)


def cycle_of(env: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Cycle in seconds (nan where there is none) and its confidence, from the most prominent autocorrelation peak between 0.33 and 1.6 s."""
    cycle, sure = np.full(len(env), np.nan), np.zeros(len(env))
    low, high = max(1, round(0.33 * rate)), min(env.shape[1] - 1, round(1.6 * rate))
    if env.shape[1] < int(2 * rate) or high <= low:
        return cycle, sure
    r = dsp.autocorrelation(env)
    for k in np.flatnonzero(env.std(axis=1) >= 1e-8):
        part = r[k, low : high + 1]
        peaks = dsp.find_peaks(part, distance=max(1, int(0.25 * rate)), prominence=0.02)
        if len(peaks):
            rise = [dsp._prominence(part, p) for p in peaks]
            best = int(np.argmax(rise))
            lag, c = low + peaks[best], rise[best] * 3 + part[peaks[best]] * 0.5
        else:
            lag, c = low + int(part.argmax()), part.max()
        if 0.33 <= lag / rate <= 1.6:
            cycle[k], sure[k] = lag / rate, min(1.0, max(0.0, c))
    return cycle, sure


def window_max(env: np.ndarray, half: int) -> np.ndarray:
    """The largest value within ``half`` of each place, also of the places up to ``half`` beyond the end."""
    wide = np.pad(env, ((0, 0), (half, 2 * half)), constant_values=-np.inf)
    return np.lib.stride_tricks.sliding_window_view(wide, 2 * half + 1, axis=1).max(axis=2)


def phase_scores(env: np.ndarray, cycle: np.ndarray, delay: np.ndarray, rate: float) -> np.ndarray:
    """For each row and phase: mean energy at the first sounds and, by 0.85, at the second sounds that the phase predicts.

    A sound's energy is the envelope's maximum within 60 ms.  All rows and phases go beat by beat; phases
    beyond a row's cycle are -inf.
    """
    n, half = env.shape[1], int(0.06 * rate)
    top = window_max(env, half)
    phases = np.arange(cycle.max())[None, :]
    total, count = np.zeros((len(env), phases.shape[1])), np.zeros((len(env), phases.shape[1]))
    for beat in range(-(-n // int(cycle.min()))):
        s1 = phases + beat * cycle[:, None]
        for at, weight in ((s1, 1.0), (s1 + delay[:, None], 0.85)):
            some = (s1 < n) & (at < n + half)
            e = np.take_along_axis(top, np.minimum(at, n + half - 1), axis=1)
            total += np.where(some, weight * e, 0.0)
            count += some
    return np.where((phases < cycle[:, None]) & (count > 0), total / np.maximum(count, 1), -np.inf)


def decode_sounds(x: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    env = sound_envelope(x, rate)
    n, seconds_sure = env.shape[1], cycle_of(env, rate)
    cycle, sure = seconds_sure[0].copy(), seconds_sure[1]
    peaks = [dsp.find_peaks(e, distance=max(1, round(0.12 * rate)), prominence=max(e.std() * 0.25, 0.03)) for e in env]
    fair = np.array([len(p) >= 3 for p in peaks])
    for k in np.flatnonzero(fair & np.isnan(cycle)):
        gaps = np.diff(peaks[k]) / rate
        gaps = gaps[(gaps >= 0.15) & (gaps <= 0.8)]
        cycle[k] = np.clip(2 * (np.median(gaps) if len(gaps) else 0.35), 0.45, 1.4)
    out = {"s1": [[]] * len(x), "s2": [[]] * len(x), "phase": np.full(len(x), np.nan), "cv": np.full(len(x), np.nan), "sure": np.full(len(x), 0.1)}
    at = np.flatnonzero(fair)
    if len(at):
        beats = np.maximum(1, np.round(cycle[at] * rate).astype(int))
        delay = np.round(np.clip(0.32 * cycle[at], 0.18, 0.45) * rate).astype(int)
        score = phase_scores(env[at], beats, delay, rate)
        reach = max(1, round(0.08 * rate))
        for j, k in enumerate(at):
            tried = peaks[k][:12] % beats[j]
            phase = int(tried[score[j, tried].argmax()])
            first = range(phase, n, int(beats[j]))
            near = lambda p: max(0, p - reach) + int(env[k, max(0, p - reach) : p + reach + 1].argmax())  # noqa: B023, E731
            out["s1"][k] = [near(p) for p in first]
            out["s2"][k] = [near(p + delay[j]) for p in first if p + delay[j] - reach < n]
            gaps = np.diff(out["s1"][k]) / rate
            cv = gaps.std() / (gaps.mean() + 1e-12) if len(gaps) else 1.0
            out["phase"][k], out["cv"][k] = phase, cv
            out["sure"][k] = np.clip(0.25 + 0.5 * sure[k] + 0.25 * max(0.0, 1 - cv), 0.1, 0.9)
    return out | {"cycle": cycle, "periodicity": sure}


def heart_sounds(signals: DataFrame, rate: float) -> DataFrame:
    """First and second heart sounds of phonocardiograms (record, values), by cycle, phase and durations.

    The cycle is that of the envelope's autocorrelation, else twice the median gap of its
    peaks; second sounds are expected 0.32 of a cycle (0.18 to 0.45 s) after first ones.  Of the phases
    of the first twelve peaks, the one with most energy at both is taken (the first of
    equals); each expected sound moves to the highest place within 80 ms.  Signals with fewer than
    three peaks have no sounds and a confidence of 0.1; null or broken ones get nulls.
    """

    def f(x):
        d = decode_sounds(x, rate)
        return {
            "s1": _lists(d["s1"]), "s2": _lists(d["s2"]), "cycle_s": _r(d["cycle"]), "periodicity": _r(d["periodicity"]), "phase_s": _r(d["phase"] / rate),
            "s1_interval_cv": _r(d["cv"]), "confidence": _r(d["sure"]),
        }

    return per_signal(signals, "s1 array<long>, s2 array<long>, cycle_s double, periodicity double, phase_s double, s1_interval_cv double, confidence double", f)


def sound_phases(sounds: DataFrame, rate: float) -> DataFrame:
    """Systole and diastole of decoded sounds: each first sound with the next second sound, and that with the first sound after it.

    Joins nothing: both kinds go on one line of events a record, and the next ones are looked up.
    Returns record, beat (from 1), s1_s, systole_s, diastole_s (null where the next sound is missing).
    """
    s1 = F.transform("s1", lambda i: F.struct(i.alias("i"), F.lit(1).alias("kind")))
    s2 = F.transform("s2", lambda i: F.struct(i.alias("i"), F.lit(2).alias("kind")))
    line = sounds.where("s1 IS NOT NULL").select("record", "s1", F.array_sort(F.array_distinct(F.concat(s1, s2))).alias("line"))
    beats = line.select("record", "line", F.posexplode("s1").alias("k", "i"))
    after = lambda kind, i: F.array_min(F.transform(F.filter("line", lambda e: (e["kind"] == kind) & (e["i"] > i)), lambda e: e["i"]))
    placed = beats.withColumn("close", after(2, F.col("i"))).withColumn("next", after(1, F.col("i")))
    fair = placed.withColumn("close", F.when(F.col("next").isNull() | (F.col("close") < F.col("next")), F.col("close")))
    seconds = lambda c: r6(c / F.lit(float(rate)))
    return fair.select("record", (F.col("k") + 1).cast("long").alias("beat"), seconds(F.col("i")).alias("s1_s"), seconds(F.col("close") - F.col("i")).alias("systole_s"), seconds(F.col("next") - F.col("close")).alias("diastole_s"))
