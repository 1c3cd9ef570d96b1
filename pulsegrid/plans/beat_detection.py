"""Queries that find beats in signals; sixteen vectors in a row are the noise of a longer signal, on which beats are laid."""

from math import cos, pi

from ..functions.columns import r6
from ..operators import beat_detection as op
from ..operators import delineation
from ..sources.tables import table
from .kernels import signals
from . import query
from pyspark.sql import functions as F

#: Samples a second of the laid beats, and of the vectors read as sounds.
ECG_RATE = 128.0
SOUND_RATE = 16.0
#: A beat around its peak, by sample (fixed values).
SHAPE = (0.15, 0.2, 0.1, -0.4, 1.2, 3.0, 1.1, -0.8, -0.3, 0.0, 0.05)
_PERIOD, _FIRST = "(70 + record % 40)", "(40 + record % 17)"


def _bump(first: int, last: int, height: float) -> dict[int, float]:
    """A raised cosine over samples around the peak of a beat."""
    return {k: height * (1 - cos(2 * pi * (k - first) / (last - first))) / 2 for k in range(first, last + 1)}


#: Beats with P and T waves, by distance from the R peak.
WHOLE = {k: 0.0 for k in range(-30, 40)} | _bump(-26, -13, 0.3) | dict(zip(range(-3, 4), (0.0, -0.2, 0.4, 3.0, 0.4, -0.4, 0.0), strict=True)) | _bump(14, 36, 0.6)


def electrocardiograms(spark, sf_dir, shape=dict(zip(range(-5, 6), SHAPE, strict=True)), noise_level=1.0):  # noqa: B006
    """record, values: the vectors of record * 16 and the 15 after it as noise, with a beat every 70 to 109 samples."""
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    parts = rows.select(F.floor(F.col("vec_id") / 16).alias("record"), F.struct("vec_id", "embedding").alias("part"))
    noise = parts.groupBy("record").agg(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["embedding"])).alias("noise"))  # sixteen vectors a record
    lift = F.array(*[F.lit(shape[k]) for k in sorted(shape)])
    step = F.expr(f"{_PERIOD}"), F.expr(f"{_FIRST}")
    laid = lambda v, i: v.cast("double") * noise_level + F.coalesce(F.get(lift, F.pmod(i - step[1] - min(shape), step[0]).cast("int")), F.lit(0.0))
    return noise.select("record", F.transform("noise", laid).alias("values"))


@query("ecg_r_peaks", f"""WITH n AS (SELECT vec_id // 16 AS record, sum(len(embedding))::BIGINT AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1),
p AS (SELECT record, unnest(generate_series({_FIRST}, n - 40, {_PERIOD})) AS peak FROM n WHERE n = 1024)
SELECT record, row_number() OVER (PARTITION BY record ORDER BY peak) AS beat, peak, CASE WHEN lag(peak) OVER (PARTITION BY record ORDER BY peak) IS NULL THEN NULL ELSE round({_PERIOD} / 128.0::DOUBLE, 6) END AS rr_s FROM p""")
def ecg_r_peaks(spark, sf_dir):
    """Detected beats but for the last 40 samples of a signal; the SQL says where beats were laid."""
    whole = electrocardiograms(spark, sf_dir).where("size(values) = 1024")
    gap = F.when(F.col("k") > 0, F.col("peak") - F.get("peaks", F.col("k") - 1))
    rows = op.r_peaks(whole, ECG_RATE).select("record", "peaks", F.posexplode("peaks").alias("k", "peak")).where("peak <= 1024 - 40")
    return rows.select("record", (F.col("k") + 1).cast("long").alias("beat"), "peak", r6(gap / F.lit(ECG_RATE)).alias("rr_s"))


@query("pcg_decoded_sounds")
def pcg_decoded_sounds(spark, sf_dir):
    return op.heart_sounds(signals(spark, sf_dir), SOUND_RATE)


@query("pcg_sound_phases")
def pcg_sound_phases(spark, sf_dir):
    return op.sound_phases(op.heart_sounds(signals(spark, sf_dir), SOUND_RATE), SOUND_RATE)


@query("ecg_delineation")
def ecg_delineation(spark, sf_dir):
    return delineation.delineate(electrocardiograms(spark, sf_dir, WHOLE, 0.03), ECG_RATE)


@query("ecg_wave_durations")
def ecg_wave_durations(spark, sf_dir):
    return delineation.wave_durations(ecg_delineation(spark, sf_dir), ECG_RATE)
