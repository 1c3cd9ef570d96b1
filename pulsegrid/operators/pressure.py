"""Arterial pressure: beat burdens and the minute rule for hypotensive episodes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import r6, share
from .events import merge_intervals


def beat_burden(beats: DataFrame) -> DataFrame:
    """Shares of beats (record, sbp, dbp) with low, severely low, high, narrow and wide pressure, and a risk."""
    pp = F.col("sbp") - F.col("dbp")
    rows = beats.withColumn("pp", pp).withColumn("map", F.col("dbp") + F.col("pp") / 3)
    a = rows.groupBy("record").agg(
        F.count("*").alias("beats"), r6(F.avg("map")).alias("mean_map"), r6(share((F.col("map") < 65) | (F.col("sbp") < 90))).alias("hypo"), r6(share(F.col("map") < 55)).alias("severe"),
        r6(share((F.col("sbp") >= 140) | (F.col("dbp") >= 90))).alias("hyper"), r6(share(F.col("pp") < 25)).alias("narrow"), r6(share(F.col("pp") > 80)).alias("wide"),
    )
    risk = (
        F.when((F.col("severe") >= 0.1) | ((F.col("hypo") >= 0.3) & (F.col("narrow") >= 0.2)), "high_hypotension")
        .when(F.col("hypo") >= 0.2, "hypotension")
        .when(F.col("hyper") >= 0.2, "hypertension")
        .otherwise("low")
    )
    return a.withColumn("risk", risk)


def hypotensive_episodes(beats: DataFrame, threshold: float = 60.0, minute: float = 60.0, window: int = 30, fraction: float = 0.9, gap: float = 1.0) -> DataFrame:
    """Episodes of mostly low mean pressure (record, t, map): trailing windows of minutes, merged.

    Minutes without beats are filled in as invalid; a window counts with at least
    ceil(fraction * window) low minutes and half of its minutes valid.  Bounds are minutes.
    """
    each = beats.groupBy("record", F.floor(F.col("t") / minute).alias("m")).agg(F.avg("map").alias("map"))
    span = each.groupBy("record").agg(F.min("m").alias("a"), F.max("m").alias("b"))
    dense = span.select("record", F.explode(F.sequence("a", "b")).alias("m")).join(each, ["record", "m"], "left")
    trail = Window.partitionBy("record").orderBy("m").rowsBetween(1 - window, 0)
    low = F.sum(F.when(r6("map") < threshold, 1).otherwise(0)).over(trail)
    rows = dense.withColumns({"low": low, "valid": F.count("map").over(trail)})
    hit = rows.where((F.col("low") >= math.ceil(fraction * window)) & (F.col("valid") >= window / 2))
    spans = hit.select("record", (F.col("m") - (window - 1)).cast("double").alias("start"), (F.col("m") + 1).cast("double").alias("end"))
    return merge_intervals(spans, gap)
