"""Patients with recordings of several sites, some missing: findings by site, pooled by patient."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import r6

#: Where heart sounds are listened to: aortic, pulmonary, tricuspid, mitral, other (fixed values).
SITES = ("AV", "PV", "TV", "MV", "Phc")


def site_recordings(patients: DataFrame, sites: tuple[str, ...] = SITES) -> DataFrame:
    """The recordings that count: patient, site, place (of the site in the list), score.

    patients: patient, recordings (array of structs with site and score).  Sites are told
    without regard to case and white space; unknown ones are left out; of several recordings of a
    site the first with a score counts.
    """
    each = patients.select("patient", F.posexplode("recordings").alias("k", "r")).select("patient", "k", F.lower(F.trim("r.site")).alias("s"), F.col("r.score").cast("double").alias("score"))
    known = F.array(*[F.lit(s.lower()) for s in sites])
    rows = each.withColumn("place", F.array_position(known, F.col("s"))).where("place > 0 AND score IS NOT NULL AND NOT isnan(score)")
    first = F.row_number().over(Window.partitionBy("patient", "place").orderBy("k"))
    kept = rows.withColumn("turn", first).where("turn = 1")
    return kept.select("patient", F.element_at(F.array(*map(F.lit, sites)), F.col("place").cast("int")).alias("site"), F.col("place").cast("int").alias("place"), "score")


def patient_rollup(patients: DataFrame, threshold: float = 0.5, margin: float = 0.05, sites: tuple[str, ...] = SITES) -> DataFrame:
    """One row a patient: sites used and missing, the mean score and its spread, the strongest site, the finding, and its confidence.

    The finding is ``present`` or ``absent`` by the mean score; ``abstain`` where it is within
    ``margin`` of the threshold while sites disagree; ``no_site`` where no site is
    known.  Confidence is 0.72 with three sites or more, 0.6 with fewer, 0.3 when abstaining, 0 without.
    """
    rows = site_recordings(patients, sites)
    positive = F.count_if(F.col("score") >= threshold)
    pooled = rows.groupBy("patient").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "site"))), lambda s: s["site"]).alias("used"), F.count("*").alias("n_sites"), r6(F.avg("score")).alias("mean"),
        (F.max("score") - F.min("score")).alias("spread"), F.max_by("site", F.struct("score", -F.col("place"))).alias("strongest"), positive.alias("positive"),
    )
    out = patients.select("patient").distinct().join(pooled, "patient", "left").fillna(0, ["n_sites", "positive"])
    split = (F.col("positive") > 0) & (F.col("positive") < F.col("n_sites"))
    finding = (
        F.when(F.col("n_sites") == 0, "no_site").when(split & (F.abs(F.col("mean") - threshold) < margin), "abstain").when(F.col("mean") >= threshold, "present").otherwise("absent")
    )
    out = out.withColumn("finding", finding)
    sure = F.when(F.col("n_sites") == 0, 0.0).when(F.col("finding") == "abstain", 0.3).when(F.col("n_sites") >= 3, 0.72).otherwise(0.6)
    used = F.coalesce("used", F.array().cast("array<string>"))
    missing = F.array_except(F.array(*map(F.lit, sites)), used)
    return out.select(
        "patient", F.array_join(used, ",").alias("used"), F.array_join(missing, ",").alias("missing"), F.col("n_sites").cast("long").alias("n_sites"),
        F.col("mean").alias("mean_score"), r6("spread").alias("spread"), "strongest", "finding", sure.alias("confidence"),
    )


def site_summary(patients: DataFrame, threshold: float = 0.5, sites: tuple[str, ...] = SITES) -> DataFrame:
    """By site over all patients: recordings that count, mean score, share at the threshold or above."""
    rows = site_recordings(patients, sites)
    return rows.groupBy("site").agg(F.count("*").alias("patients"), r6(F.avg("score")).alias("mean_score"), r6(F.avg((F.col("score") >= threshold).cast("int"))).alias("present_share"))
