"""Waveform images as pixel tables (image, x, y, v): traces, profiles and layout figures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import r6


def column_traces(pixels: DataFrame) -> DataFrame:
    """Mean and median height of the marked pixels of each column, and how many there are."""
    return pixels.groupBy("image", "x").agg(r6(F.avg("y")).alias("mean_y"), F.median("y").alias("median_y"), F.count("*").alias("pixels"))


def filled_trace(pixels: DataFrame, least: int = 1) -> DataFrame:
    """The median trace; columns of fewer than ``least`` pixels are on the line between their neighbours."""
    trace = pixels.groupBy("image", "x").agg(F.median("y").alias("y"), F.count("*").alias("pixels")).where(F.col("pixels") >= least).drop("pixels")
    span = trace.groupBy("image").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    dense = span.select("image", F.explode(F.sequence("a", "b")).alias("x")).join(trace, ["image", "x"], "left")
    order = Window.partitionBy("image").orderBy("x")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("y").isNotNull(), F.col("x"))
    rows = dense.withColumns({"x0": F.last(at, True).over(before), "y0": F.last("y", True).over(before), "x1": F.first(at, True).over(after), "y1": F.first("y", True).over(after)})
    line = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    return rows.select("image", "x", r6(F.coalesce("y", line)).alias("y"), F.col("y").isNull().alias("filled"))


def profile_peaks(pixels: DataFrame, axis: str) -> DataFrame:
    """Local maxima of the projection on an axis that exceed mean + deviation: how many lines the layout has."""
    profile = pixels.groupBy("image", axis).agg(F.sum("v").alias("p"))
    order, whole = Window.partitionBy("image").orderBy(axis), Window.partitionBy("image")
    rows = profile.withColumns({"before": F.lag("p").over(order), "after": F.lead("p").over(order), "limit": F.avg("p").over(whole) + F.stddev_pop("p").over(whole)})
    top = (F.col("p") > F.col("before")) & (F.col("p") >= F.col("after")) & (F.col("p") > F.col("limit"))
    return rows.groupBy("image").agg(F.count("*").alias("lines"), F.count_if(top).alias("peaks"))


def intensity_entropy(pixels: DataFrame, bins: int) -> DataFrame:
    """Shannon entropy in bits of the histogram of values in 0 .. 1."""
    counts = pixels.groupBy("image", F.least(F.floor(F.col("v") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("image")))
    return p.groupBy("image").agg(r6(-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.count("*").alias("bins"))


def layout(pixels: DataFrame) -> DataFrame:
    """Width and height of the content, its share of the frame around it, and pixels a column."""
    a = pixels.groupBy("image").agg((F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"), F.count_distinct("x", "y").alias("n"), F.count_distinct("x").alias("columns"))
    return a.select("image", "width", "height", r6(F.col("n") / (F.col("width") * F.col("height"))).alias("density"), r6(F.col("n") / F.col("columns")).alias("per_column"))


def _median(y: np.ndarray, n: np.ndarray) -> float:
    """The median of ascending values that stand for n each."""
    ends = np.cumsum(n)
    return float(y[np.searchsorted(ends, [(ends[-1] - 1) // 2, ends[-1] // 2], "right")].mean())


def following_trace(pixels: DataFrame, jump: float = 0.12, momentum: float = 0.0) -> DataFrame:
    """From column to column the pixel nearest to where the trace points; columns without one within ``jump`` of the height are skipped.

    With momentum 0 it points to the last height, with 1 along the last step; it starts at the
    median of the first column.  The scan carries state, so it runs per image, over one row a
    place with the count of its pixels: the size of an image bounds a group, not that of the table.
    """

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        height, out, last, step = max(1.0, float(pdf.y.max() - pdf.y.min() + 1)), [], None, 0.0
        for x, g in pdf.sort_values("y").groupby("x"):
            y = g.y.to_numpy(float)
            aim = _median(y, g.n.to_numpy()) if last is None else last + momentum * step
            best = float(y[np.abs(y - aim).argmin()])
            if last is not None and abs(best - aim) > jump * height:
                continue
            step, last = (0.0 if last is None else best - last), best
            out.append((int(g.image.iloc[0]), int(x), best))
        return pd.DataFrame(out, columns=["image", "x", "y"])

    places = pixels.groupBy("image", "x", "y").agg(F.count("*").alias("n"))
    return places.groupBy("image").applyInPandas(f, "image long, x long, y double")
