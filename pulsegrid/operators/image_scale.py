"""Axis scales of waveform images: ruled lines and their spacing, faint periodic grids, and the most plausible duration.

Lines come from windows and aggregates over pixel rows (image, x, y, grey), so no image is ever
gathered.  What is gathered is a profile, one number a column, which is as long as an image is wide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions.columns import flags, r6
from ..sources.scratch import dealt, written
from .spectral import per_signal

#: Grey below which a pixel may belong to a line, and below which it is content at all.
LINE_GREY = 220
CONTENT_GREY = 245
#: A stroke may have holes of so many pixels; it is a line when it spans this share of the image, and at least 80 pixels.
HOLE = 6
SPAN = 0.65
#: Share of marked pixels above which a column or row is a line in any case.
DENSE = 0.45


#: Pixels of both axes that a task sorts.
TASK_PIXELS = 1_000_000


def _marked(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Columns and rows with dark pixels: image, axis, at (the column or row), density, span (of the longest stroke), across and length (sizes of the image).

    Pixels are dealt once, by the column or row that they are in, and sorted there; repeated pixels have no distance from the one before.
    """
    dark = pixels.dropna(subset=["image", "x", "y", "grey"]).where(F.col("grey") < LINE_GREY)
    both = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("x").cast("long").alias("at"), F.col("y").cast("long").alias("along")), F.struct(F.lit("y").alias("axis"), F.col("y").cast("long").alias("at"), F.col("x").cast("long").alias("along"))))
    rows = dealt(dark.select("image", both.alias("p")).select("image", "p.*"), 2 * dark.count(), TASK_PIXELS, "image", "axis", "at")
    order = Window.partitionBy("image", "axis", "at").orderBy("along")
    step = F.col("along") - F.lag("along").over(order)
    rows = rows.withColumns({"new": F.coalesce((step > HOLE + 1).cast("int"), F.lit(1)), "other": F.coalesce((step > 0).cast("int"), F.lit(1))})
    strokes = rows.withColumn("stroke", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    strokes = strokes.groupBy("image", "axis", "at", "stroke").agg(F.sum("other").alias("n"), (F.max("along") - F.min("along")).alias("span"))
    marked = strokes.groupBy("image", "axis", "at").agg(F.sum("n").alias("n"), F.max("span").alias("span")).join(sizes.select("image", "width", "height"), "image")
    is_x = F.col("axis") == "x"
    across, length = F.when(is_x, F.col("width")).otherwise(F.col("height")), F.when(is_x, F.col("height")).otherwise(F.col("width"))
    return marked.select("image", "axis", "at", (F.col("n") / length).alias("density"), "span", across.alias("across"), length.alias("length"))


def ruled_lines(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Lines of each image: image, axis (x: upright lines, y: level ones), line (numbered from 1), centre, thickness.

    pixels: image, x, y, grey (0 is black); sizes: image, width, height.  A column is part of a
    line if it holds a stroke over SPAN of the image without a hole of more than HOLE pixels, or is marked over more
    than DENSE and more than 99 % of columns are.  Neighbouring columns within 2.5 pixels (or 0.3 %
    of the width, for rows 0.5 % of the height) of the one before are one line.  Nulls are left out, repeated pixels count once.
    """
    marked = written(_marked(pixels, sizes), "marked")
    # the 99 % level counts columns without a mark as well
    filled = marked.groupBy("image", "axis").agg((F.first("across") - F.count("*")).alias("many")).where("many > 0")
    levels = marked.select("image", "axis", "density", F.lit(1).cast("long").alias("many")).unionByName(filled.select("image", "axis", F.lit(0.0).alias("density"), F.col("many").cast("long")))
    levels = levels.groupBy("image", "axis").agg(F.percentile("density", 0.99, F.col("many")).alias("level"))
    ruled = (F.col("span") >= F.greatest(F.lit(80.0), SPAN * F.col("length"))) | (F.col("density") > F.greatest(F.lit(DENSE), F.col("level")))
    gap = F.greatest(F.lit(2.5), F.col("across") * F.when(F.col("axis") == "x", 0.003).otherwise(0.005))
    along = Window.partitionBy("image", "axis").orderBy("at")
    lines = marked.join(levels, ["image", "axis"]).where(ruled).withColumn("new", F.coalesce((F.col("at") - F.lag("at").over(along) > gap).cast("int"), F.lit(1)))
    lines = lines.withColumn("line", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return lines.groupBy("image", "axis", "line").agg(r6(F.avg("at")).alias("centre"), (F.max("at") - F.min("at") + 1).alias("thickness"))


def axis_scale(pixels: DataFrame, sizes: DataFrame, seconds_per_grid: float | None = None, value_per_grid: float | None = None, duration_s: float | None = None) -> DataFrame:
    """One row an image with content: its plot area, lines and their median spacing, and the physical scale that follows.

    Spacings of 4 pixels or less are no grid.  The duration is the given one, or that of the plot's width in
    grid steps; the sampling rate is the plot's width over the duration.  What is missing for a full scale is named in ``missing``.
    """
    content = pixels.dropna(subset=["image", "x", "y", "grey"]).where(F.col("grey") < CONTENT_GREY)
    box = content.groupBy("image").agg(*[f(c).cast("long").alias(f"{c}_{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
    lines = ruled_lines(pixels, sizes)
    step = lines.withColumn("step", F.col("centre") - F.lag("centre").over(Window.partitionBy("image", "axis").orderBy("centre")))
    of = lambda a, c: F.when(F.col("axis") == a, c)
    wide = F.when(F.col("step") > 4, F.col("step"))
    spaced = step.groupBy("image").agg(*[F.count(of(a, F.col("centre"))).alias(f"lines_{a}") for a in "xy"], *[r6(F.median(of(a, wide))).alias(f"spacing_{a}") for a in "xy"])
    out = box.join(spaced, "image", "left").fillna(0, ["lines_x", "lines_y"])
    width, height = F.col("x_max") - F.col("x_min") + 1, F.col("y_max") - F.col("y_min") + 1
    constant = lambda v: F.lit(v).cast("double")
    known: Column = F.coalesce(constant(duration_s), width / F.col("spacing_x") * constant(seconds_per_grid))
    out = out.withColumns({"duration_s": r6(known), "rate_hz": r6(width / known), "value_span": r6(height / F.col("spacing_y") * constant(value_per_grid))})
    weights = {"spacing_x": 0.25, "spacing_y": 0.20, "rate_hz": 0.15, "value_span": 0.15}
    sure = F.lit(0.25)
    for c, w in weights.items():
        sure = sure + F.when(F.col(c).isNotNull(), w).otherwise(0.0)
    missing = F.array_join(flags((F.col("rate_hz").isNull(), "duration"), (F.col("value_span").isNull(), "value_per_grid")), ",")
    return out.withColumns({"missing": missing, "confidence": r6(F.least(F.lit(0.95), sure))})


def profiles(pixels: DataFrame, sizes: DataFrame, axis: str = "x") -> DataFrame:
    """record (the image), values: the share of dark pixels of each column (or row), one array as long as the image is wide."""
    dense = _marked(pixels, sizes).where(F.col("axis") == axis).select("image", "at", F.col("density").alias("d"), "across")
    marked = dense.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("at", "d"))).alias("m"), F.first("across").alias("n"))
    return marked.select(F.col("image").alias("record"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.lit(1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("values"))


def comb_spacing(profile: DataFrame, least: int = 5, sure: float = 0.25) -> DataFrame:
    """The spacing of a periodic grid in profiles (record, values), and the strength of its vote; null where none is periodic.

    Profiles are smoothed over three columns, so that a spacing between whole pixels still meets its lines.  Every
    lag, in eighths of a pixel, has a comb of up to four teeth laid on the autocorrelation: its vote is the mean at the teeth less
    the mean halfway between them.  Odd multiples of a spacing get as much, so the least lag within 20 % of the
    best wins.  Up to eight teeth are then read to a pixel, which gives the spacing to a fraction of one.
    """

    def f(x):
        n = x.shape[1]
        wide = np.pad(x, ((0, 0), (1, 1)), mode="edge")
        r = dsp.autocorrelation(wide[:, :-2] / 4 + x / 2 + wide[:, 2:] / 4) * (n / (n - np.arange(n)))
        reach = n * 3 // 4  # beyond it too few columns overlap

        def at(places):
            low = places.astype(int)
            return r[:, low] + (places - low) * (r[:, low + 1] - r[:, low])

        lags = np.arange(least, max(least + 1, n // 3), 0.125)
        votes = np.zeros((len(x), len(lags)))
        for i, lag in enumerate(lags):
            teeth = lag * np.arange(1, min(4, int(reach // lag)) + 1)
            if len(teeth):
                votes[:, i] = (at(teeth) - at(teeth - lag / 2)).mean(axis=1)
        best = votes.max(axis=1)
        spacing = np.full(len(x), np.nan)
        for i, lag in enumerate(lags[(votes >= 0.8 * best[:, None]).argmax(axis=1)]):
            if best[i] >= sure and np.ptp(x[i]) > 0:
                spacing[i] = lag
                for k in range(1, min(8, int(reach // lag)) + 1):  # each tooth is looked for near where the last one puts it
                    first = max(1, round(k * spacing[i]) - 2)
                    spacing[i] = (first + int(r[i, first : first + 5].argmax())) / k
        return {"spacing": np.round(spacing, 6), "vote": np.round(best, 6)}

    return per_signal(profile, "spacing double, vote double", f, 16)


#: Plausible beats or breaths a minute and the pass band of kinds of signals; others read as pulse waves (fixed values).
PLAUSIBLE = {
    "ecg": (35.0, 220.0, 0.5, 35.0),
    "ppg": (35.0, 220.0, 0.4, 8.0),
    "abp": (35.0, 220.0, 0.4, 12.0),
    "bcg": (35.0, 220.0, 0.6, 18.0),
    "scg": (35.0, 220.0, 0.8, 25.0),
    "resp": (6.0, 40.0, 0.05, 0.8),
}


def peak_evidence(y: np.ndarray, rate: float, slow: float, fast: float) -> tuple[float, float, int, float]:
    """For one filtered trace: evidence that its peaks are beats of ``slow`` to ``fast`` a minute, plausibility, peaks, rate a minute.

    Evidence weighs the rate (0.45), regular intervals (0.25), the count (0.20) and the prominence of peaks (0.10).
    Intervals without any variation, as of two peaks, are no evidence of being regular.
    """
    sd, n = float(y.std()), len(y)
    if sd <= 1e-10:
        return 0.0, 0.0, 0, np.nan
    peaks = dsp.find_peaks(y, distance=max(1, round(rate * 60 / fast * 0.8)))
    heights = np.array([dsp._prominence(y, p) for p in peaks])
    at = heights >= max(0.25 * sd, 1e-8)
    peaks, heights = peaks[at], heights[at]
    bpm, plausible, regular, prominent = np.nan, 0.0, 0.0, 0.0
    if len(peaks) > 1:
        gaps = np.diff(peaks) / rate
        bpm = 60 / float(np.median(gaps))
        regular = 1 - min(float(gaps.std() / gaps.mean()) or 1.0, 1.0)
        plausible = max(0.0, 1 - max(0.0, slow - bpm) / slow - max(0.0, bpm - fast) / fast)
    if len(peaks):
        prominent = float(np.tanh(np.median(heights) / (sd + 1e-8)))
    fewest = max(2, int(slow / 60 * n / rate * 0.6))
    most = max(fewest + 1, int(np.ceil(fast / 60 * n / rate * 1.4)))
    count = 1.0 if fewest <= len(peaks) <= most else 0.4 if len(peaks) > 1 else 0.0
    return 0.45 * plausible + 0.25 * regular + 0.20 * count + 0.10 * prominent, plausible, len(peaks), bpm


def choose_duration(traces: DataFrame, candidates: list[tuple[float, float | None]], kind: str = "ppg") -> DataFrame:
    """Which of some durations a trace (record, values) has, by the plausibility of its peaks: duration_s, rate_hz, bpm, peaks, score, margin, confirm.

    candidates: seconds with a prior of 0 to 1 or None, best first; without prior the place in the list counts, 1 / place.
    A trace read at each duration is filtered and its peaks, up or down, are weighed; peaks are a
    veto rather than a measure, so the prior leads where several durations are plausible.  Of
    equal scores the earlier candidate wins.  ``confirm`` asks for a person: a score below 0.72 or a margin below 0.12.
    """
    slow, fast, low, high = PLAUSIBLE.get(kind, (35.0, 220.0, 0.4, 12.0))

    def f(x):
        n = x.shape[1]
        table = np.zeros((len(candidates), len(x), 3))  # score, peaks, rate a minute
        for c, (seconds, prior) in enumerate(candidates):
            rate = n / seconds
            centred = x - np.median(x, axis=1, keepdims=True)
            y = dsp.bandpass(x, rate, low, high) if n > max(12, int(rate)) else centred
            trust = prior if prior else 1 / (c + 1)
            for i, row in enumerate(y):
                # a trace that does not vary has nothing to weigh
                both = [peak_evidence(s * row, rate, slow, fast) for s in (1, -1)] if centred[i].std() > 1e-10 else [(0.0, 0.0, 0, np.nan)]
                weight, plausible, peaks, bpm = max(both, key=lambda e: e[0])
                gate = 0.18 if peaks < 2 else 0.78 + 0.22 * weight if plausible >= 0.75 else 0.45 + 0.25 * weight
                table[c, i] = min(1.0, 0.82 * trust * gate + 0.10 * weight + 0.08), peaks, bpm
        best = table[:, :, 0].argmax(axis=0)
        score, peaks, bpm = table[best, np.arange(len(x))].T
        second = np.sort(table[:, :, 0], axis=0)[-2] if len(candidates) > 1 else np.zeros(len(x))
        seconds = np.array([c[0] for c in candidates], float)[best]
        return {"duration_s": seconds, "rate_hz": np.round(n / seconds, 6), "bpm": np.round(bpm, 6), "peaks": peaks.astype(int), "score": np.round(score, 6), "margin": np.round(score - second, 6), "confirm": (score < 0.72) | (score - second < 0.12)}

    return per_signal(traces, "duration_s double, rate_hz double, bpm double, peaks long, score double, margin double, confirm boolean", f)
