"""Features of uniformly sampled signals (record, idx, x) that need no kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ladder, r6, share


def _all() -> Window:
    return Window.partitionBy("record")


def _order() -> Window:
    return Window.partitionBy("record").orderBy("idx")


def rolling_rms(samples: DataFrame, width: int) -> DataFrame:
    """Root mean square about each sample, zero-padded at the ends: a fixed divisor."""
    near = _order().rowsBetween(-(width // 2), (width - 1) // 2)
    return samples.withColumn("rms", F.sqrt(F.sum(F.col("x") * F.col("x")).over(near) / width))


def rolling_median(samples: DataFrame, width: int) -> DataFrame:
    """Median of an odd window about each sample, zero-padded at the ends."""
    near = F.collect_list("x").over(_order().rowsBetween(-(width // 2), width // 2))
    return samples.withColumn("_near", near).withColumn("median", F.array_sort(F.concat("_near", F.array_repeat(F.lit(0.0), width - F.size("_near"))))[width // 2]).drop("_near")


def emg_time_features(samples: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Time-domain activation features: absolute value, RMS, waveform length, crossings, slope changes, Wilson amplitude."""
    step, ahead, before = F.col("x") - F.lag("x").over(_order()), F.lead("x").over(_order()) - F.col("x"), F.lag("x").over(_order())
    rows = samples.select("record", "x", step.alias("d1"), ahead.alias("d2"), before.alias("px"))
    return rows.groupBy("record").agg(
        r6(F.avg(F.abs("x"))).alias("mav"), r6(F.sqrt(F.avg(F.col("x") * F.col("x")))).alias("rms"), r6(F.coalesce(F.sum(F.abs("d1")), F.lit(0.0))).alias("waveform_length"),
        r6(F.var_pop("x")).alias("variance"), F.count_if(F.col("x") * F.col("px") < 0).alias("zero_crossings"), F.count_if(F.col("d1") * F.col("d2") < 0).alias("slope_changes"),
        r6(F.sum(F.abs("x"))).alias("iemg"), F.count_if(F.abs("d1") > threshold).alias("wilson"),
    )


def coactivation(samples: DataFrame) -> DataFrame:
    """How many channels are active at a time (record, idx, channel, x), and how often two or more are."""
    own = Window.partitionBy("record", "channel")
    rows = samples.withColumn("a", F.abs("x")).withColumn("thr", F.median("a").over(own) + F.stddev_pop("a").over(own))
    active = rows.groupBy("record", "idx").agg(F.count_if(F.col("a") > F.col("thr")).alias("active"))
    return active.groupBy("record").agg(r6(F.avg("active")).alias("mean_active"), r6(share(F.col("active") >= 2)).alias("coactivation"))


def tonic_phasic(samples: DataFrame, width: int = 5) -> DataFrame:
    """Slow level by a rolling median, and what is left."""
    rows = rolling_median(samples, width).withColumn("phasic", F.col("x") - F.col("median"))
    return rows.groupBy("record").agg(r6(F.avg("median")).alias("tonic_mean"), r6(F.stddev_pop("median")).alias("tonic_sd"), r6(F.stddev_pop("phasic")).alias("phasic_sd"))


def slope(samples: DataFrame, rate: float) -> DataFrame:
    """The line through a signal over seconds."""
    t = F.col("idx") / F.lit(rate)
    return samples.groupBy("record").agg(r6(F.regr_slope("x", t)).alias("slope"), r6(F.regr_intercept("x", t)).alias("intercept"))


def hjorth(samples: DataFrame) -> DataFrame:
    """Activity, mobility and complexity from the variances of a signal and its differences."""
    rows = samples.withColumn("d", F.col("x") - F.lag("x").over(_order())).withColumn("dd", F.col("d") - F.lag("d").over(_order()))
    v = rows.groupBy("record").agg(F.var_pop("x").alias("v0"), F.var_pop("d").alias("v1"), F.var_pop("dd").alias("v2"))
    mobility = F.sqrt(F.col("v1") / F.col("v0"))
    return v.select("record", r6("v0").alias("activity"), r6(mobility).alias("mobility"), r6(F.sqrt(F.col("v2") / F.col("v1")) / mobility).alias("complexity"))


def sliding_summary(samples: DataFrame, width: int, step: int) -> DataFrame:
    """Mean and span in windows of ``width`` samples every ``step``; an incomplete window is dropped."""
    first = F.greatest(F.ceil((F.col("idx") - (width - 1)) / step), F.lit(0))
    rows = samples.withColumn("n", F.count("*").over(_all())).withColumn("start", F.explode(F.sequence(first.cast("long"), F.floor(F.col("idx") / step).cast("long"))))
    rows = rows.withColumn("start", F.col("start") * step)
    return rows.where(F.col("start") + width <= F.col("n")).groupBy("record", "start").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("mean"), r6(F.max("x") - F.min("x")).alias("span"))


def interpolate(samples: DataFrame) -> DataFrame:
    """Fills missing samples on the line between their neighbours; constant before the first and after the last."""
    before, after = _order().rowsBetween(Window.unboundedPreceding, 0), _order().rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("x").isNotNull(), F.col("idx"))
    i0, i1 = F.last(at, True).over(before), F.first(at, True).over(after)
    rows = samples.select("record", "idx", "x", i0.alias("i0"), i1.alias("i1"), F.last("x", True).over(before).alias("x0"), F.first("x", True).over(after).alias("x1"))
    line = F.when(F.col("i0").isNull(), F.col("x1")).when(F.col("i1").isNull(), F.col("x0")).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("idx") - F.col("i0")) / (F.col("i1") - F.col("i0")))
    return rows.select("record", "idx", r6(F.coalesce("x", line)).alias("x"))


def dual_channel_ratio(beats: DataFrame, red: str, infrared: str) -> DataFrame:
    """Ratio of ratios of two channels and the saturation it stands for, between 50 and 100."""
    each = beats.where(F.col("kind").isin(red, infrared)).groupBy("record").pivot("kind", [red, infrared]).agg((F.percentile("x", F.lit(0.95)) - F.percentile("x", F.lit(0.05))).alias("ac"), F.median("x").alias("dc"))
    r = (F.col(f"{red}_ac") / F.col(f"{red}_dc")) / (F.col(f"{infrared}_ac") / F.col(f"{infrared}_dc"))
    each = each.where((F.col(f"{red}_dc") > 0) & (F.col(f"{infrared}_dc") > 0) & (F.col(f"{infrared}_ac") > 0))
    return each.select("record", r6(r).alias("ratio"), r6(F.greatest(F.lit(50.0), F.least(F.lit(100.0), 110 - 25 * r))).alias("spo2"))


def modality_scores(samples: DataFrame) -> DataFrame:
    """Additive scores of kinds of signal by thresholds on their features, normalised, ranked."""
    rows = samples.withColumn("s", F.signum(F.col("x") - F.median("x").over(_all()))).withColumn("cross", F.col("s") * F.lag("s").over(_order()) < 0)
    f = rows.groupBy("record").agg(
        r6(F.stddev_pop("x")).alias("sd"), r6(F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25))).alias("iqr"),
        r6(F.count_if("cross") / F.count("cross")).alias("rate"), r6(F.avg("x")).alias("mean"),
    )
    when = lambda test, v: F.when(test, v).otherwise(0.0)
    score = {
        "slow": 1.0 + when(F.col("rate") < 0.45, 2.0) + when(F.abs("mean") > 0.01, 0.5),
        "fast": 1.0 + when(F.col("rate") > 0.5, 2.0),
        "spiky": 1.0 + when(F.col("sd") > F.col("iqr") * 0.8, 1.5),
        "wide": 1.0 + when(F.col("iqr") > 0.17, 1.5),
    }
    each = f.select("record", F.explode(F.array(*[F.struct(F.lit(k).alias("modality"), v.alias("score")) for k, v in score.items()])).alias("e"))
    p = each.select("record", "e.modality", r6(F.col("e.score") / F.sum("e.score").over(_all())).alias("probability"))
    return p.withColumn("rank", F.row_number().over(_all().orderBy(F.desc("probability"), "modality")).cast("long"))


def resolution_risk(images: DataFrame) -> DataFrame:
    """Pixels per cycle of a plotted signal (image, width, duration, hz), the risk in digitizing it, and what to do."""
    ppc = F.col("width") / F.col("duration") / F.col("hz")
    return images.select(
        "image", r6(ppc).alias("pixels_per_cycle"), ladder(ppc, [(8, "low"), (3, "moderate")], "high").alias("risk"),
        ladder(ppc, [(8, "digitize"), (3, "digitize_with_caution")], "classify_image").alias("strategy"),
    )
