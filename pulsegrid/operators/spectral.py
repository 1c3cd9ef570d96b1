"""Analyses that need numeric kernels: signals as arrays, one row each, in Arrow batches.

Signals are rows, so nothing is shuffled; rows of one length are handled together as a matrix.
Signals that are null, empty or hold missing samples get null results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions.columns import r6


def per_signal(signals: DataFrame, schema: str, f: Callable[[np.ndarray], dict[str, np.ndarray]], least: int = 16) -> DataFrame:
    """Applies f (matrix to columns) to signals (record, values); schema names the columns after record."""
    kinds = [tuple(c.split()) for c in schema.split(", ")]
    names = [n for n, _ in kinds]
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}

    def run(batches):
        for b in batches:
            rows = b.column("values").to_pylist()
            out = {n: [None] * len(rows) for n in names}
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(rows):
                if v is not None and len(v) >= least and None not in v and np.isfinite(v).all():
                    by_length.setdefault(len(v), []).append(i)
            for at in by_length.values():
                for n, column in f(np.array([rows[i] for i in at], float)).items():
                    for i, v in zip(at, column.tolist(), strict=True):
                        out[n][i] = None if isinstance(v, float) and np.isnan(v) else v
            columns = [pa.array(out[n], types[t]) for n, t in kinds]
            yield pa.RecordBatch.from_arrays([b.column("record"), *columns], ["record", *names])

    return signals.select(F.col("record").cast("long"), "values").mapInArrow(run, f"record long, {schema}")


def _r(x: np.ndarray) -> np.ndarray:
    return np.round(x, 6)


def bandpower(signals: DataFrame, rate: float) -> DataFrame:
    """Power in the delta, theta, alpha, beta and gamma bands and in all, by Welch, and a stage hint from their shares."""
    bands = {"delta": (0.5, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "gamma": (30, 45)}

    def f(x):
        hz, p = dsp.welch(x, rate, int(2 * rate))
        out = {k: dsp.band_power(hz, p, *b) for k, b in bands.items()}
        total = np.maximum(sum(out.values()), 1e-12)
        d, t, a, b = (out[k] / total for k in ("delta", "theta", "alpha", "beta"))
        stage = np.select([d > 0.45, (t > 0.30) & (a < 0.20), (a > 0.25) | (b > 0.25)], ["deep", "light", "wake"], "uncertain")
        return {k: _r(v) for k, v in out.items()} | {"total": _r(total), "stage": stage.astype(object)}

    return per_signal(signals, "delta double, theta double, alpha double, beta double, gamma double, total double, stage string", f)


def spectrogram(signals: DataFrame, rate: float, window: float = 0.5) -> DataFrame:
    """Centroid, 85 % roll-off, entropy and variation over time of a spectrogram with half overlap."""

    def f(x):
        m = max(8, int(window * rate))
        parts = np.stack([x[:, s : s + m] for s in range(0, x.shape[1] - m + 1, m // 2)], axis=1)
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(m) / m)
        p = np.abs(np.fft.rfft((parts - parts.mean(axis=2, keepdims=True)) * w, axis=2)) ** 2 / (rate * (w**2).sum())
        hz, mean, time = np.fft.rfftfreq(m, 1 / rate), p.mean(axis=1), p.sum(axis=2)
        total = np.maximum(mean.sum(axis=1), 1e-12)
        q = mean / total[:, None]
        entropy = -(q * np.log2(np.maximum(q, 1e-12))).sum(axis=1) / np.log2(q.shape[1])
        roll = hz[(np.cumsum(q, axis=1) >= 0.85 - 1e-12).argmax(axis=1)]
        return {"bins": np.full(len(x), p.shape[1]), "centroid_hz": _r(q @ hz), "rolloff_hz": _r(roll), "entropy": _r(entropy), "temporal_cv": _r(time.std(axis=1) / np.maximum(time.mean(axis=1), 1e-12))}

    return per_signal(signals, "bins long, centroid_hz double, rolloff_hz double, entropy double, temporal_cv double", f)


def bandpass_peaks(signals: DataFrame, rate: float, low: float, high: float, scale: float = 0.35) -> DataFrame:
    """Peaks of the filtered signal by robust prominence, their rate and the variation of their gaps."""

    def f(x):
        y = dsp.bandpass(x, rate, low, high)
        n, bpm, cv = [], [], []
        for row in y:
            mad = 1.4826 * np.median(np.abs(row - np.median(row)))
            peaks = dsp.find_peaks(row, distance=max(1, int(rate / high)), prominence=scale * (mad or row.std()))
            gap = np.diff(peaks) / rate
            n.append(len(peaks))
            bpm.append(60 / np.median(gap) if len(gap) else np.nan)
            cv.append(gap.std() / gap.mean() if len(gap) else np.nan)
        return {"peaks": np.array(n), "rate_bpm": _r(np.array(bpm)), "gap_cv": _r(np.array(cv))}

    return per_signal(signals, "peaks long, rate_bpm double, gap_cv double", f)


def candidate_arbitration(signals: DataFrame, rate: float, bands: list[tuple[float, float]]) -> DataFrame:
    """Peak detectors of several bands against the dominant frequency of the envelope: the best scored band, and its score.

    0.85 for agreement with the spectral rate, 0.15 for regular gaps; the first of equals.
    """

    def f(x):
        env = dsp.envelope(dsp.bandpass(x, rate, bands[0][0], bands[-1][1]))
        hz, p = dsp.welch(env, rate, x.shape[1])
        inside = (hz >= 0.5) & (hz <= rate / 4)
        dominant = 60 * hz[inside][p[:, inside].argmax(axis=1)]
        scores, rates = [], []
        for low, high in bands:
            y = dsp.bandpass(x, rate, low, high)
            s, r = [], []
            for row, d in zip(y, dominant, strict=True):
                gap = np.diff(dsp.find_peaks(row, distance=max(1, int(rate / (2 * high))), prominence=0.5 * row.std())) / rate
                bpm = 60 / np.median(gap) if len(gap) else np.nan
                fit = max(0.0, 1 - abs(bpm - d) / d) if len(gap) else 0.0
                s.append(0.85 * fit + 0.15 * (max(0.0, 1 - gap.std() / gap.mean()) if len(gap) > 1 else 0.0))
                r.append(bpm)
            scores.append(s)
            rates.append(r)
        scores, rates = np.round(np.array(scores), 9), np.array(rates)
        best = scores.argmax(axis=0)
        at = np.arange(len(x))
        return {"band": best, "rate_bpm": _r(rates[best, at]), "spectral_bpm": _r(dominant), "score": _r(scores[best, at])}

    return per_signal(signals, "band long, rate_bpm double, spectral_bpm double, score double", f)


def dominant_cycle(signals: DataFrame, rate: float, shortest: float, longest: float) -> DataFrame:
    """The lag of the highest autocorrelation of the envelope within bounds in seconds, and that correlation."""

    def f(x):
        r = dsp.autocorrelation(dsp.envelope(x - x.mean(axis=1, keepdims=True)))
        lo, hi = max(1, int(shortest * rate)), min(x.shape[1] - 1, int(longest * rate))
        lag = r[:, lo : hi + 1].argmax(axis=1) + lo
        return {"cycle_s": _r(lag / rate), "periodicity": _r(r[np.arange(len(x)), lag])}

    return per_signal(signals, "cycle_s double, periodicity double", f)


def median_frequency(signals: DataFrame, rate: float, low: float, high: float) -> DataFrame:
    """The frequency below which half of the power of a band lies; low values read as fatigue."""

    def f(x):
        hz, p = dsp.welch(x, rate, x.shape[1])
        at = (hz >= low) & (hz <= high)
        c = np.cumsum(p[:, at], axis=1)
        mid = hz[at][(c >= c[:, -1:] / 2).argmax(axis=1)]
        return {"median_hz": _r(mid), "fatigue": (mid < (low + high) / 3)}

    return per_signal(signals, "median_hz double, fatigue boolean", f)


def hrv_frequency(intervals: DataFrame, rate: float = 4.0, segment_s: float = 64.0) -> DataFrame:
    """Low and high frequency power of intervals (record, t, dt) on a 4 Hz grid; needs 8 intervals over 30 s, else the powers are null.

    Each pair of neighbouring beats gives the grid points between them, and points go to the half overlapping
    segments that hold them.  Segments are arrays, a row each; power is averaged over them, since the
    integral of a mean spectrum is the mean of integrals.  No task holds a record: it is sorted once by time, which
    spills.  A record of less than a segment is one shorter segment.  Rows with a null are left out; of intervals that end at the same time the longest counts.
    """
    size = int(segment_s * rate)
    all_, order = Window.partitionBy("record"), Window.partitionBy("record").orderBy("t", "dt")
    rows = intervals.select(F.col("record").cast("long"), F.col("t").cast("double"), F.col("dt").cast("double")).dropna()
    rows = rows.select("*", F.min("t").over(all_).alias("t0"), F.max("t").over(all_).alias("t1"), F.count("*").over(all_).alias("n"), F.lead("t").over(order).alias("next"), F.lead("dt").over(order).alias("next_dt"))
    place = lambda t: F.ceil((F.col(t) - F.col("t0")) * rate)
    pairs = rows.where((F.col("n") >= 8) & (F.col("t1") - F.col("t0") >= 30)).withColumns({"a": place("t"), "b": place("next") - 1, "m": place("t1")}).where("a <= b")
    at = F.col("t0") + F.col("g") / rate
    x = 1000 * (F.col("dt") + (F.col("next_dt") - F.col("dt")) * (at - F.col("t")) / (F.col("next") - F.col("t")))
    grid = pairs.withColumn("g", F.explode(F.sequence("a", "b"))).select("record", "m", "g", x.alias("x"))
    half = size - size // 2
    of = F.floor(F.col("g") / half)
    grid = grid.withColumn("s", F.explode(F.array(of, of - 1))).where((F.col("s") == 0) | ((F.col("s") > 0) & (F.col("s") * half + size <= F.col("m")))).where(F.col("g") - F.col("s") * half < size)
    cut = grid.groupBy("record", "s").agg(F.sort_array(F.collect_list(F.struct("g", "x")))["x"].alias("values"))  # at most a segment of points

    def f(v):
        hz, p = dsp.welch(v, rate, size)
        return {"lf": dsp.band_power(hz, p, 0.04, 0.15), "hf": dsp.band_power(hz, p, 0.15, 0.40)}

    powers = per_signal(cut, "lf double, hf double", f).groupBy("record").agg(F.avg("lf").alias("lf"), F.avg("hf").alias("hf"))
    out = rows.groupBy("record").agg(F.count("*").alias("n")).join(powers, "record", "left")
    return out.select("record", "n", r6("lf").alias("lf"), r6("hf").alias("hf"), r6(F.try_divide("lf", "hf")).alias("lf_hf"))


def minimum_path(masks: DataFrame, jump: float = 0.08, distance: float = 0.02) -> DataFrame:
    """The cheapest left-to-right trace through candidate pixels (image, x, y), one y for each column that has any.

    Each step costs ``jump`` for every pixel up or down and each pixel ``distance`` for its
    distance from the median of its column; dynamic programming over columns, per image.
    """

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = [(x, np.sort(g.y.to_numpy(float))) for x, g in pdf.groupby("x")]
        back: list[np.ndarray] = []
        for k, (_, y) in enumerate(columns):
            if not k:  # the first column is reached from anywhere
                cost, before = np.zeros(len(y)), y
            own = distance * np.abs(y - np.median(y))
            step = cost[:, None] + jump * np.abs(before[:, None] - y[None, :])
            back.append(step.argmin(axis=0))
            cost, before = step.min(axis=0) + own, y
        k, out = int(cost.argmin()), []
        for (x, y), b in zip(reversed(columns), reversed(back), strict=True):
            out.append((pdf.image.iloc[0], x, y[k]))
            k = int(b[k])
        return pd.DataFrame(out[::-1], columns=["image", "x", "y"])

    return masks.groupBy("image").applyInPandas(f, "image long, x long, y double")
