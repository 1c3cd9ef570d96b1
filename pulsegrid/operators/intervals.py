"""Beat intervals: cleaning, variability, rhythm and pulse irregularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import flags, ladder, points, r6, ratio, share


def _all() -> Window:
    return Window.partitionBy("record")


def _order() -> Window:
    return Window.partitionBy("record").orderBy("idx")


def intervals(beats: DataFrame) -> DataFrame:
    """Positive gaps between beats: record, idx, t, dt (seconds since the beat before)."""
    return beats.withColumn("dt", F.col("t") - F.lag("t").over(_order())).where("dt > 0").select("record", "idx", "t", "dt")


def clean_intervals(beats: DataFrame, low: float = 0.25, high: float = 3.0, floor: float = 0.25, scale: float = 4.5, least: int = 3) -> DataFrame:
    """Plausible intervals near the median: |dt - median| <= max(floor, scale * MAD), where there are enough."""
    rows = intervals(beats).where(F.col("dt").between(low, high))
    rows = rows.withColumn("median", F.median("dt").over(_all())).withColumn("n", F.count("*").over(_all()))
    rows = rows.withColumn("mad", F.median(F.abs(F.col("dt") - F.col("median"))).over(_all()) + 1e-8)
    near = F.abs(F.col("dt") - F.col("median")) <= F.greatest(F.lit(floor), scale * F.col("mad"))
    return rows.where((F.col("n") < least) | near)


def _successive(rows: DataFrame) -> DataFrame:
    return rows.withColumn("diff", F.col("dt") - F.lag("dt").over(_order()))


def interval_regularity(beats: DataFrame) -> DataFrame:
    """Confidence in regular beats from the variation of their intervals (population deviation over mean)."""
    out = intervals(beats).groupBy("record").agg(F.count("*").alias("n"), ratio(F.stddev_pop("dt"), F.avg("dt")).alias("cv"))
    confidence = F.when(F.col("n") < 2, 0.35).when(F.col("cv") < 0.15, 0.9).when(F.col("cv") < 0.3, 0.75).when(F.col("cv") < 0.5, 0.55).otherwise(0.35)
    return out.select("record", "n", r6("cv").alias("cv"), confidence.alias("confidence"))


def hrv_time(beats: DataFrame) -> DataFrame:
    """Time-domain variability in milliseconds, Poincaré axes and rhythm flags."""
    ms = _successive(clean_intervals(beats).withColumn("dt", F.col("dt") * 1000))
    out = ms.groupBy("record").agg(
        F.count("*").alias("n"),
        F.avg("dt").alias("mean"),
        F.stddev_samp("dt").alias("sdnn"),
        F.stddev_samp("diff").alias("sdsd"),
        F.sqrt(F.avg(F.col("diff") * F.col("diff"))).alias("rmssd"),
        F.count_if(F.abs("diff") > 20).alias("nn20"),
        F.count_if(F.abs("diff") > 50).alias("nn50"),
    )
    out = out.where("n >= 3")
    sd2 = F.sqrt(F.greatest(F.lit(0.0), 2 * F.col("sdnn") ** 2 - F.col("sdsd") ** 2 / 2))
    rate = 60000 / F.col("mean")
    found = flags((rate < 60, "slow"), (rate > 100, "fast"), (F.col("sdnn") / F.col("mean") > 0.15, "variable"), (F.col("rmssd") > 100, "irregular"))
    risk = ladder(F.size(found), [(2, "high"), (1, "moderate")], "low")
    return out.select(
        "record", "n", r6("mean").alias("mean_rr_ms"), r6(rate).alias("mean_hr_bpm"), r6("sdnn").alias("sdnn_ms"), r6("sdsd").alias("sdsd_ms"),
        r6("rmssd").alias("rmssd_ms"), "nn20", "nn50", r6(F.col("nn50") / (F.col("n") - 1)).alias("pnn50"),
        r6(F.col("sdsd") * F.sqrt(F.lit(0.5))).alias("sd1_ms"), r6(sd2).alias("sd2_ms"), F.array_join(found, ",").alias("flags"), risk.alias("risk"),
    )


def beat_labels(beats: DataFrame) -> DataFrame:
    """Each beat between two others: premature, pause or normal, by both intervals against the record's median."""
    prev, after = F.col("t") - F.lag("t").over(_order()), F.lead("t").over(_order()) - F.col("t")
    rows = beats.withColumn("prev", prev).withColumn("next", after)
    both = rows.select("record", F.explode(F.array("prev", "next")).alias("v")).groupBy("record").agg(F.median("v").alias("med"))
    rows = rows.where("prev is not null and next is not null").join(both, "record")
    label = F.when((F.col("prev") < 0.75 * F.col("med")) & (F.col("next") > 1.15 * F.col("med")), "premature").when(F.col("prev") > 1.4 * F.col("med"), "pause").otherwise("normal")
    return rows.select("record", "idx", r6("prev").alias("prev_s"), r6("next").alias("next_s"), label.alias("label"))


def interval_features(beats: DataFrame) -> DataFrame:
    """Per record: n, mean, cv, normalised RMSSD, shares of successive differences and of turning points."""
    rows = _successive(intervals(beats).where(F.col("dt").between(0.25, 3.0)))
    turn = (F.col("dt") - F.lag("dt").over(_order())) * (F.lag("dt").over(_order()) - F.lag("dt", 2).over(_order()))
    return (
        rows.withColumn("turn", turn)
        .groupBy("record")
        .agg(
            F.count("*").alias("n"),
            F.avg("dt").alias("mean"),
            F.stddev_pop("dt").alias("sd"),
            F.sqrt(F.avg(F.col("diff") * F.col("diff"))).alias("rmssd"),
            share(F.col("diff").isNotNull() & (F.abs("diff") > 0.12)).alias("big"),
            F.count("diff").alias("diffs"),
            F.count_if(F.col("turn") < 0).alias("turns"),
            F.count("turn").alias("triples"),
        )
        .withColumn("succ", F.col("big") * F.col("n") / F.col("diffs"))
        .withColumn("cv", F.col("sd") / F.col("mean"))
        .withColumn("nrmssd", F.col("rmssd") / F.col("mean"))
    )


def pulse_irregularity(beats: DataFrame) -> DataFrame:
    """A score of 0 to 4 from interval variation; elevated from 2.  Needs five intervals."""
    out = interval_features(beats).where("n >= 5")
    score = points(F.col("cv") > 0.16, F.col("nrmssd") > 0.18, F.col("succ") > 0.25, (F.col("succ") > 0.45) & (F.col("nrmssd") > 0.14))
    return out.select("record", "n", r6("cv").alias("cv"), r6("nrmssd").alias("nrmssd"), r6("succ").alias("succ"), score.alias("score"), F.when(score >= 2, "elevated").otherwise("low").alias("risk"))


def turning_points(beats: DataFrame) -> DataFrame:
    """The share of interior intervals that are a local extreme."""
    return interval_features(beats).where("triples > 0").select("record", "turns", "triples", r6(F.col("turns") / F.col("triples")).alias("turning_ratio"))


def afib_heuristic(beats: DataFrame) -> DataFrame:
    """A probability of irregular rhythm from three bounded terms, and its risk level."""
    out = interval_features(beats).where("n >= 5")
    p = 0.4 * F.least(F.col("cv") / 0.3, F.lit(1.0)) + 0.35 * F.least(F.col("nrmssd") / 0.35, F.lit(1.0)) + 0.25 * F.least(F.col("turns") / F.greatest("triples", F.lit(1)) / 0.7, F.lit(1.0))
    return out.select("record", r6(p).alias("probability"), F.when(r6(p) >= 0.7, "high").when(r6(p) >= 0.4, "moderate").otherwise("low").alias("risk"))


def prv_time(beats: DataFrame) -> DataFrame:
    """Pulse rate variability in milliseconds; intervals have a lower bound of 0.25 s only."""
    rows = _successive(intervals(beats).where("dt > 0.25").withColumn("dt", F.col("dt") * 1000))
    out = rows.groupBy("record").agg(
        F.count("*").alias("n"), F.stddev_samp("dt").alias("sdnn"), F.sqrt(F.avg(F.col("diff") * F.col("diff"))).alias("rmssd"),
        F.count_if(F.abs("diff") > 50).alias("nn50"), F.median("dt").alias("median"),
    )
    return out.where("n >= 3").select("record", "n", r6(60000 / F.col("median")).alias("mean_hr_bpm"), r6("sdnn").alias("sdnn_ms"), r6("rmssd").alias("rmssd_ms"), r6(F.col("nn50") / (F.col("n") - 1)).alias("pnn50"))


def stress_score(beats: DataFrame) -> DataFrame:
    """Points for a fast rate and low variability; stress-compatible from 1.5."""
    prv = prv_time(beats)
    score = F.when(F.col("mean_hr_bpm") > 90, 1.0).otherwise(0.0) + F.when(F.col("rmssd_ms") < 300, 0.75).otherwise(0.0) + F.when(F.col("sdnn_ms") < 500, 0.5).otherwise(0.0)
    return prv.select("record", score.alias("score"), F.when(score >= 1.5, "stress_compatible").otherwise("not_elevated").alias("level"))


def exercise_zone(beats: DataFrame, resting_bpm: float | None = None, max_bpm: float | None = None) -> DataFrame:
    """Intensity by heart-rate reserve, share of the maximum, or (bpm - 60) / 100, clamped to 0 - 1.2, in four zones."""
    bpm = F.col("mean_hr_bpm")
    if resting_bpm is not None and max_bpm is not None:
        raw = (bpm - resting_bpm) / (max_bpm - resting_bpm)
    else:
        raw = bpm / max_bpm if max_bpm is not None else (bpm - 60) / 100
    level = r6(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.2)))
    return prv_time(beats).select("record", "mean_hr_bpm", level.alias("intensity"), ladder(level, [(0.9, "maximal"), (0.7, "vigorous"), (0.45, "moderate")], "light").alias("zone"))


def qt_correction(waves: DataFrame) -> DataFrame:
    """Bazett and Fridericia corrections of QT (ms) by RR (s), with flags: record, idx, qt_ms, rr_s."""
    bazett, frid = F.col("qt_ms") / F.sqrt("rr_s"), F.col("qt_ms") / F.cbrt("rr_s")
    level = F.when(bazett > 500, "markedly_prolonged").when(bazett > 470, "prolonged").when(bazett < 340, "short").otherwise("normal")
    return waves.select("record", "idx", r6(bazett).alias("qtc_bazett_ms"), r6(frid).alias("qtc_fridericia_ms"), level.alias("flag"))
