"""Signal quality, artifacts and distributions of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import flags, r6, ratio, share


def signal_quality(samples: DataFrame, *keys: str) -> DataFrame:
    """Range, finite share and clipped share of each signal, and good, moderate or bad."""
    by = keys or ("record",)
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    rows = samples.withColumn("ok", finite).withColumn("x", F.when(finite, F.col("x"))).withColumn("top", F.max(F.abs("x")).over(Window.partitionBy(*by)))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        share(F.col("ok")).alias("finite"),
        (F.percentile("x", F.lit(0.95)) - F.percentile("x", F.lit(0.05))).alias("range"),
        F.when(F.max("top") == 0, 1.0).otherwise(share(F.abs("x") >= 0.999 * F.col("top"))).alias("clip"),
    )
    bad = (F.col("finite") < 0.99) | (F.col("range") == 0) | (F.col("clip") > 0.2) | F.col("range").isNull()
    level = F.when(bad, "bad").when(F.col("clip") > 0.05, "moderate").otherwise("good")
    confidence = F.when(bad, 0.2).when(F.col("clip") > 0.05, 0.6).otherwise(0.85)
    return out.select(*by, "n", r6("finite").alias("finite_ratio"), r6("range").alias("signal_range"), r6("clip").alias("clip_ratio"), level.alias("quality"), confidence.alias("confidence"))


def artifact_flags(samples: DataFrame) -> DataFrame:
    """Flat, clipped and jumping signals: flags and low, moderate or high artifact level."""
    x = F.col("x")
    edges = samples.groupBy("record").agg((F.percentile("x", F.lit(0.95)) - F.percentile("x", F.lit(0.05))).alias("range"), F.stddev_pop("x").alias("sd"), F.max(F.abs("x")).alias("top"))
    rows = samples.withColumn("step", F.abs(x - F.lag("x").over(Window.partitionBy("record").orderBy("idx")))).join(edges, "record")
    jump_at = F.greatest(5 * F.col("sd"), 0.5 * F.col("range"), F.lit(1e-8))
    out = rows.groupBy("record", "range").agg(share(F.abs("x") >= 0.999 * F.col("top")).alias("clip"), ratio(F.count_if(F.col("step") > jump_at), F.count("step")).alias("jump"))
    found = flags((F.col("range") <= 1e-8, "flatline"), (F.col("clip") > 0.05, "clipping"), (F.col("jump") > 0.01, "jumps"))
    level = F.when((F.size(found) >= 2) | (F.col("range") <= 1e-8), "high").when(F.size(found) == 1, "moderate").otherwise("low")
    return out.select("record", r6("range").alias("signal_range"), r6("clip").alias("clip_ratio"), r6("jump").alias("jump_ratio"), F.array_join(found, ",").alias("flags"), level.alias("level"))


def distribution_moments(samples: DataFrame) -> DataFrame:
    """Mean, deviation, population skewness and excess kurtosis, quartiles, IQR and scaled MAD of each signal."""
    rows = samples.join(samples.groupBy("record").agg(F.median("x").alias("med")), "record")
    out = rows.groupBy("record").agg(
        F.count("*").alias("n"), r6(F.avg("x")).alias("mean"), r6(F.stddev_pop("x")).alias("sd"), r6(F.skewness("x")).alias("skewness"), r6(F.kurtosis("x")).alias("kurtosis"),
        r6(F.percentile("x", F.lit(0.25))).alias("q25"), r6(F.first("med")).alias("median"), r6(F.percentile("x", F.lit(0.75))).alias("q75"),
        r6(F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25))).alias("iqr"), r6(1.4826 * F.median(F.abs(F.col("x") - F.col("med")))).alias("mad"),
    )
    return out


def zero_crossings(samples: DataFrame) -> DataFrame:
    """Changes of sign about the median, as a count and a rate."""
    whole = Window.partitionBy("record")
    rows = samples.withColumn("s", F.signum(F.col("x") - F.median("x").over(whole)))
    rows = rows.withColumn("cross", F.col("s") * F.lag("s").over(whole.orderBy("idx")) < 0)
    return rows.groupBy("record").agg(F.count_if("cross").alias("crossings"), r6(ratio(F.count_if("cross"), F.count("cross"))).alias("rate"))


def perfusion_windows(samples: DataFrame, width: int = 30, step: int = 15) -> DataFrame:
    """Range over baseline in sliding windows, and how much that varies; an incomplete window is dropped."""
    n = F.count("*").over(Window.partitionBy("record"))
    first = F.greatest(F.ceil((F.col("idx") - (width - 1)) / step), F.lit(0))
    rows = samples.withColumn("n", n).withColumn("w", F.explode(F.sequence(first.cast("int"), F.floor(F.col("idx") / step).cast("int"))))
    rows = rows.where(F.col("w") * step + width <= F.col("n"))
    each = rows.groupBy("record", "w").agg(ratio(F.percentile("x", F.lit(0.95)) - F.percentile("x", F.lit(0.05)), F.abs(F.median("x")) + 1e-3).alias("index"))
    return each.groupBy("record").agg(F.count("*").alias("windows"), r6(F.median("index")).alias("perfusion"), r6(ratio(F.stddev_pop("index"), F.avg("index"))).alias("variability"))
