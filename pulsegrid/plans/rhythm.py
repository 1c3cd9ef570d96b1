"""Interval and rhythm queries over the beats of each user."""

from ..functions.columns import r6
from ..operators import intervals as op
from ..sources.tables import BEATS_SQL, beats
from . import query
from pyspark.sql import functions as F

RR = f"""WITH {BEATS_SQL},
steps AS (SELECT *, t - lag(t) OVER (PARTITION BY record ORDER BY idx) AS dt FROM beats),
rr AS (SELECT record, idx, t, dt FROM steps WHERE dt > 0)"""
CLEAN = RR + """,
plausible AS (SELECT *, median(dt) OVER (PARTITION BY record) AS med, count(*) OVER (PARTITION BY record) AS n FROM rr WHERE dt BETWEEN 0.25 AND 3.0),
spread AS (SELECT *, median(abs(dt - med)) OVER (PARTITION BY record) + 1e-8 AS mad FROM plausible),
clean AS (SELECT * FROM spread WHERE n < 3 OR abs(dt - med) <= greatest(0.25, 4.5 * mad))"""
FEATURES = RR + """,
kept AS (SELECT *, dt - lag(dt) OVER w AS diff, (dt - lag(dt) OVER w) * (lag(dt) OVER w - lag(dt, 2) OVER w) AS turn
  FROM rr WHERE dt BETWEEN 0.25 AND 3.0 WINDOW w AS (PARTITION BY record ORDER BY idx)),
f AS (SELECT record, count(*) AS n, stddev_pop(dt) / avg(dt) AS cv, sqrt(avg(diff * diff)) / avg(dt) AS nrmssd,
  count(*) FILTER (WHERE abs(diff) > 0.12) / nullif(count(diff), 0)::DOUBLE AS succ,
  count(*) FILTER (WHERE turn < 0) AS turns, count(turn) AS triples FROM kept GROUP BY record)"""
PRV = RR + """,
ms AS (SELECT record, dt * 1000 AS dt, dt * 1000 - lag(dt * 1000) OVER (PARTITION BY record ORDER BY idx) AS diff FROM rr WHERE dt > 0.25),
prv AS (SELECT record, count(*) AS n, round(60000 / median(dt), 6) AS mean_hr_bpm, round(stddev_samp(dt), 6) AS sdnn_ms, round(sqrt(avg(diff * diff)), 6) AS rmssd_ms,
  round(count(*) FILTER (WHERE abs(diff) > 50) / (count(*) - 1)::DOUBLE, 6) AS pnn50 FROM ms GROUP BY record HAVING count(*) >= 3)"""


@query("entry_hrv_flags", CLEAN + """,
ms AS (SELECT record, dt * 1000 AS dt, dt * 1000 - lag(dt * 1000) OVER (PARTITION BY record ORDER BY idx) AS diff FROM clean),
a AS (SELECT record, count(*) AS n, avg(dt) AS mean, stddev_samp(dt) AS sdnn, stddev_samp(diff) AS sdsd, sqrt(avg(diff * diff)) AS rmssd,
  count(*) FILTER (WHERE abs(diff) > 20) AS nn20, count(*) FILTER (WHERE abs(diff) > 50) AS nn50 FROM ms GROUP BY record HAVING count(*) >= 3),
b AS (SELECT *, list_filter([CASE WHEN 60000 / mean < 60 THEN 'slow' END, CASE WHEN 60000 / mean > 100 THEN 'fast' END,
  CASE WHEN sdnn / mean > 0.15 THEN 'variable' END, CASE WHEN rmssd > 100 THEN 'irregular' END], lambda x: x IS NOT NULL) AS fl FROM a)
SELECT record, n, round(mean, 6) AS mean_rr_ms, round(60000 / mean, 6) AS mean_hr_bpm, round(sdnn, 6) AS sdnn_ms, round(sdsd, 6) AS sdsd_ms,
  round(rmssd, 6) AS rmssd_ms, nn20, nn50, round(nn50 / (n - 1)::DOUBLE, 6) AS pnn50, round(sdsd * sqrt(0.5::DOUBLE), 6) AS sd1_ms,
  round(sqrt(greatest(0, 2 * sdnn * sdnn - sdsd * sdsd / 2)), 6) AS sd2_ms, array_to_string(fl, ',') AS flags,
  CASE WHEN len(fl) >= 2 THEN 'high' WHEN len(fl) = 1 THEN 'moderate' ELSE 'low' END AS risk FROM b""")
def entry_hrv_flags(spark, sf_dir):
    return op.hrv_time(beats(spark, sf_dir))


@query("interval_regularity", RR + """,
a AS (SELECT record, count(*) AS n, coalesce(stddev_pop(dt) / avg(dt), 0) AS cv FROM rr GROUP BY record)
SELECT record, n, round(cv, 6) AS cv, CASE WHEN n < 2 THEN 0.35::DOUBLE WHEN cv < 0.15 THEN 0.9 WHEN cv < 0.3 THEN 0.75 WHEN cv < 0.5 THEN 0.55 ELSE 0.35 END AS confidence FROM a""")
def interval_regularity(spark, sf_dir):
    return op.interval_regularity(beats(spark, sf_dir))


@query("clean_intervals_mad", CLEAN + " SELECT record, idx, round(dt, 6) AS dt, round(med, 6) AS median, n FROM clean")
def clean_intervals_mad(spark, sf_dir):
    rows = op.clean_intervals(beats(spark, sf_dir))
    return rows.select("record", "idx", r6("dt").alias("dt"), r6("median").alias("median"), "n")


@query("beat_labels", f"""WITH {BEATS_SQL},
p AS (SELECT *, t - lag(t) OVER w AS prev, lead(t) OVER w - t AS next FROM beats WINDOW w AS (PARTITION BY record ORDER BY idx)),
m AS (SELECT record, median(v) AS med FROM (SELECT record, unnest([prev, next]) AS v FROM p) GROUP BY record),
l AS (SELECT p.*, CASE WHEN prev < 0.75 * med AND next > 1.15 * med THEN 'premature' WHEN prev > 1.4 * med THEN 'pause' ELSE 'normal' END AS label
  FROM p JOIN m USING (record) WHERE prev IS NOT NULL AND next IS NOT NULL)
SELECT record, idx, round(prev, 6) AS prev_s, round(next, 6) AS next_s, label FROM l""")
def beat_labels(spark, sf_dir):
    return op.beat_labels(beats(spark, sf_dir))


@query("pulse_irregularity", FEATURES + """,
s AS (SELECT *, (cv > 0.16)::INT + (nrmssd > 0.18)::INT + coalesce(succ > 0.25, false)::INT + coalesce(succ > 0.45 AND nrmssd > 0.14, false)::INT AS score FROM f WHERE n >= 5)
SELECT record, n, round(cv, 6) AS cv, round(nrmssd, 6) AS nrmssd, round(succ, 6) AS succ, score, CASE WHEN score >= 2 THEN 'elevated' ELSE 'low' END AS risk FROM s""")
def pulse_irregularity(spark, sf_dir):
    return op.pulse_irregularity(beats(spark, sf_dir))


@query("turning_points", FEATURES + " SELECT record, turns, triples, round(turns / triples::DOUBLE, 6) AS turning_ratio FROM f WHERE triples > 0")
def turning_points(spark, sf_dir):
    return op.turning_points(beats(spark, sf_dir))


@query("afib_heuristic", FEATURES + """,
p AS (SELECT record, round(0.4::DOUBLE * least(cv / 0.3::DOUBLE, 1) + 0.35::DOUBLE * least(nrmssd / 0.35::DOUBLE, 1)
  + 0.25::DOUBLE * least(turns / greatest(triples, 1)::DOUBLE / 0.7::DOUBLE, 1), 6) AS probability FROM f WHERE n >= 5)
SELECT record, probability, CASE WHEN probability >= 0.7 THEN 'high' WHEN probability >= 0.4 THEN 'moderate' ELSE 'low' END AS risk FROM p""")
def afib_heuristic(spark, sf_dir):
    return op.afib_heuristic(beats(spark, sf_dir))


@query("prv_time_domain", PRV + " SELECT record, n, mean_hr_bpm, sdnn_ms, rmssd_ms, pnn50 FROM prv")
def prv_time_domain(spark, sf_dir):
    return op.prv_time(beats(spark, sf_dir))


@query("stress_score", PRV + """,
s AS (SELECT record, (CASE WHEN mean_hr_bpm > 90 THEN 1.0 ELSE 0 END + CASE WHEN rmssd_ms < 300 THEN 0.75 ELSE 0 END + CASE WHEN sdnn_ms < 500 THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM prv)
SELECT record, score, CASE WHEN score >= 1.5 THEN 'stress_compatible' ELSE 'not_elevated' END AS level FROM s""")
def stress_score(spark, sf_dir):
    return op.stress_score(beats(spark, sf_dir))


@query("exercise_zone", PRV + """,
z AS (SELECT record, mean_hr_bpm, round(least(greatest((mean_hr_bpm - 60) / 100, 0), 1.2::DOUBLE), 6) AS intensity FROM prv)
SELECT record, mean_hr_bpm, intensity, CASE WHEN intensity >= 0.9 THEN 'maximal' WHEN intensity >= 0.7 THEN 'vigorous' WHEN intensity >= 0.45 THEN 'moderate' ELSE 'light' END AS zone FROM z""")
def exercise_zone(spark, sf_dir):
    return op.exercise_zone(beats(spark, sf_dir))


@query("qt_correction", RR + """,
w AS (SELECT r.record, r.idx, 300 + 200 * (x - floor(x)) AS qt_ms, dt AS rr_s FROM rr r JOIN beats b ON r.record = b.record AND r.idx = b.idx WHERE dt BETWEEN 0.25 AND 3.0)
SELECT record, idx, round(qt_ms / sqrt(rr_s), 6) AS qtc_bazett_ms, round(qt_ms / cbrt(rr_s), 6) AS qtc_fridericia_ms,
  CASE WHEN qt_ms / sqrt(rr_s) > 500 THEN 'markedly_prolonged' WHEN qt_ms / sqrt(rr_s) > 470 THEN 'prolonged' WHEN qt_ms / sqrt(rr_s) < 340 THEN 'short' ELSE 'normal' END AS flag FROM w""")
def qt_correction(spark, sf_dir):
    b = beats(spark, sf_dir)
    rr = op.intervals(b).where("dt between 0.25 and 3.0")
    waves = rr.join(b.select("record", "idx", "x"), ["record", "idx"])
    return op.qt_correction(waves.select("record", "idx", (300 + 200 * (F.col("x") - F.floor("x"))).alias("qt_ms"), F.col("dt").alias("rr_s")))
