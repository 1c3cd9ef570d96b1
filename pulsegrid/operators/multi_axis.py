"""Windows over three aligned axes of a chest sensor: spectra by axis, coherence between axes, and averages locked to beats.

Records are rows that hold an array an axis, so nothing is shuffled.  A record is filtered as a
whole, since its filter has no seams then, and gives one row a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions.columns import r6
from .beat_detection import r_peak_lists

AXES = ("lat", "hf", "dv")
#: Samples a second after resampling, and the pass band of an axis.
RATE = 100.0
BAND = (0.8, 35.0)
#: Bands whose share of all power is reported; the upper end of noise is cut at 0.45 of the rate (fixed values).
BANDS = {"cardiac": (0.8, 20.0), "resp": (0.08, 0.7), "noise": (35.0, 80.0), "systolic": (5.0, 30.0)}
#: Seconds before and after a beat that are averaged.
LOCK = (0.1, 0.5)
_PAIRS = tuple((a, b) for i, a in enumerate(AXES) for b in AXES[i + 1 :])
FEATURES = (
    *[f"{a}_{n}" for a in ("mag", *AXES) for n in ("std", "iqr", "p95_abs", *[f"{b}_ratio" for b in BANDS])],
    *[f"coherence_{a}_{b}" for a, b in _PAIRS], *[f"beat_{a}_{n}" for a in AXES for n in ("span", "likeness")], "hr_bpm", "rr_cv",
)


def axis_features(x: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    """Spread, size and band shares of each row."""
    x = x - np.median(x, axis=1, keepdims=True)
    hz, p = dsp.welch(x, rate, min(x.shape[1], int(max(8 * rate, 16))))
    total = np.trapezoid(p, hz, axis=1) + 1e-12
    out = {"std": x.std(axis=1), "iqr": np.subtract(*np.percentile(x, (75, 25), axis=1)), "p95_abs": np.percentile(np.abs(x), 95, axis=1)}
    for name, (low, high) in BANDS.items():
        at = (hz >= low) & (hz <= min(high, max(0.45 * rate, BANDS["cardiac"][1])))
        out[f"{name}_ratio"] = np.trapezoid(p[:, at], hz[at], axis=1) / total if at.any() else np.zeros(len(x))
    return out


def coherence(x: np.ndarray, y: np.ndarray, rate: float, seconds: float = 2.0) -> np.ndarray:
    """The mean coherence of rows over the cardiac band, from Hann windows with half overlap; null below four windows."""
    m = min(x.shape[1], int(seconds * rate))
    starts = range(0, x.shape[1] - m + 1, max(1, m // 2))
    if len(starts) < 4:
        return np.full(len(x), np.nan)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)

    def spectra(v):
        parts = np.stack([v[:, s : s + m] for s in starts], axis=1)
        return np.fft.rfft((parts - parts.mean(axis=2, keepdims=True)) * window, axis=2)

    a, b = spectra(x), spectra(y)
    cross, own = np.abs((a * b.conj()).mean(axis=1)) ** 2, (np.abs(a) ** 2).mean(axis=1) * (np.abs(b) ** 2).mean(axis=1)
    hz = np.fft.rfftfreq(m, 1 / rate)
    at = (hz >= BANDS["cardiac"][0]) & (hz <= BANDS["cardiac"][1])
    return np.divide(cross, own, out=np.zeros_like(own), where=own > 1e-24)[:, at].mean(axis=1)


def beat_average(x: np.ndarray, peaks: np.ndarray, rate: float) -> tuple[float, float]:
    """Of one axis: highest less lowest of the average around beats, and the mean correlation of beats with the average of the others."""
    before, after = int(LOCK[0] * rate), int(LOCK[1] * rate)
    whole = peaks[(peaks >= before) & (peaks + after <= len(x))]
    if len(whole) < 2:
        return np.nan, np.nan
    beats = np.stack([x[p - before : p + after] for p in whole])
    beats = beats - beats.mean(axis=1, keepdims=True)
    mean = beats.mean(axis=0)
    others = (beats.sum(axis=0) - beats) / (len(beats) - 1)
    size = np.sqrt((beats**2).sum(axis=1) * (others**2).sum(axis=1))
    return float(np.ptp(mean)), float(np.divide((beats * others).sum(axis=1), size, out=np.zeros(len(beats)), where=size > 1e-12).mean())


def axis_windows(records: DataFrame, rate: float, window_s: float = 20.0, stride_s: float = 20.0) -> DataFrame:
    """One row a window of each record: record, window (from 0), start_s, beats, and FEATURES.

    records: record, lat, hf, dv, ecg: arrays of samples, ``rate`` a second; ecg may be null or shorter, and then
    windows it does not cover have null beat figures.  Axes count up to the shortest; samples that are
    null or not finite on any axis are left out on all (of the electrocardiogram too).  A record shorter than a window is one window; one of
    fewer than 16 samples, or with an axis that is null, has none.  All windows are returned.  Repeated records give repeated rows.
    """
    number = lambda c, i: F.get(c, i).cast("double")
    shortest = F.least(*[F.size(a) for a in AXES])
    rows = records.where(" AND ".join(f"{a} IS NOT NULL" for a in AXES)).where(shortest > 0)
    aligned = F.transform(F.sequence(F.lit(0), shortest - 1), lambda i: F.struct(*[number(a, i).alias(a) for a in AXES], number("ecg", i).alias("ecg")))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    aligned = F.filter(aligned, lambda s: fine(s["lat"]) & fine(s["hf"]) & fine(s["dv"]))
    rows = rows.select(F.col("record").cast("long"), aligned.alias("s")).where("size(s) >= 16")
    rows = rows.select("record", *[F.col(f"s.{a}").alias(a) for a in (*AXES, "ecg")])

    def resampled(x: np.ndarray) -> np.ndarray:
        return x if rate == RATE else dsp.resample(x, max(1, round(x.shape[1] * RATE / rate)))

    def windows(batches):
        for b in batches:
            lists = {a: b.column(a).to_pylist() for a in (*AXES, "ecg")}
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(lists["lat"]):
                by_length.setdefault(len(v), []).append(i)
            for n, at in by_length.items():
                axes = {a: resampled(dsp.bandpass(np.array([lists[a][i] for i in at], float), rate, *BAND)) for a in AXES}
                axes = {"mag": np.sqrt(sum(v**2 for v in axes.values())), **axes}
                m = axes["mag"].shape[1]
                # nulls become nan; an electrocardiogram covers its samples before the first of them
                ecg = np.array([lists["ecg"][i] for i in at], float)
                covered = np.where(np.isfinite(ecg).all(axis=1), n, (~np.isfinite(ecg)).argmax(axis=1))
                ecg = resampled(np.nan_to_num(ecg))
                size, step = min(m, max(round(window_s * RATE), 8)), max(round(stride_s * RATE), 1)
                for w, start in enumerate(range(0, m - size + 1, step)):
                    yield one(b.column("record").take(pa.array(at)), w, start, {a: v[:, start : start + size] for a, v in axes.items()}, ecg[:, start : start + size], covered * RATE / rate >= start + size - 0.5)

    def one(record, w, start, part, ecg, covered):
        k = len(record)
        out = {f"{a}_{n}": v for a, x in part.items() for n, v in axis_features(x, RATE).items()}
        for a, c in _PAIRS:
            out[f"coherence_{a}_{c}"] = coherence(part[a], part[c], RATE)
        out |= {c: np.full(k, np.nan) for c in FEATURES if c not in out}
        beats: list[int | None] = [None] * k
        for i in np.flatnonzero(covered):
            peaks = np.asarray(r_peak_lists(ecg[i : i + 1], RATE)[0][0], int)
            beats[i] = len(peaks)
            if len(peaks) > 1:
                rr = np.diff(peaks) / RATE
                out["hr_bpm"][i], out["rr_cv"][i] = 60 / np.median(rr), rr.std() / (rr.mean() + 1e-12)
            for a in AXES:
                out[f"beat_{a}_span"][i], out[f"beat_{a}_likeness"][i] = beat_average(part[a][i], peaks, RATE)
        figures = [pa.array(np.round(out[c], 6), from_pandas=True) for c in FEATURES]
        return pa.RecordBatch.from_arrays([record, pa.array([w] * k, pa.int64()), pa.array([start / RATE] * k), pa.array(beats, pa.int64()), *figures], ["record", "window", "start_s", "beats", *FEATURES])

    return rows.mapInArrow(windows, "record long, window long, start_s double, beats long, " + ", ".join(f"{c} double" for c in FEATURES))


def axis_summary(windows: DataFrame) -> DataFrame:
    """One row a record of ``axis_windows``: windows, those with beats, medians of the main figures, the axis that beats show on best, and the most coherent pair.

    A record without beats has a null axis; of equal axes (or pairs) the first named wins.
    """
    middle = {c: F.median(c) for c in ("mag_std", "mag_cardiac_ratio", "mag_noise_ratio", "hr_bpm", *[f"beat_{a}_likeness" for a in AXES], *[f"coherence_{a}_{b}" for a, b in _PAIRS])}
    out = windows.groupBy("record").agg(F.count("*").alias("windows"), F.count_if(F.col("beats") > 1).alias("with_beats"), *[r6(v).alias(c) for c, v in middle.items()])

    def best(columns: dict[str, str]):
        top, name = F.greatest(*[F.col(c) for c in columns]), F
        for c, label in columns.items():
            name = name.when(F.col(c) == top, label)
        return name

    out = out.withColumns({"best_axis": best({f"beat_{a}_likeness": a for a in AXES}), "best_pair": best({f"coherence_{a}_{b}": f"{a}_{b}" for a, b in _PAIRS})})
    return out.select("record", "windows", "with_beats", "mag_std", "mag_cardiac_ratio", "mag_noise_ratio", "hr_bpm", "best_axis", "best_pair")
