"""Queries of composite screens and of feature vectors."""

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import screens as op
from ..sources.tables import BEATS_SQL, OXIMETRY_SQL, SAMPLES_SQL, beats, oximetry, samples
from . import query

_FEATURES = f"""WITH {BEATS_SQL}, a AS (SELECT *, t - lag(t) OVER w AS dt, abs(x - lag(x) OVER w) AS step FROM beats WINDOW w AS (PARTITION BY record ORDER BY idx)),
d AS (SELECT *, dt - lag(dt) OVER (PARTITION BY record ORDER BY idx) AS ddt FROM a), mid AS (SELECT record, median(x) AS level, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) AS span FROM beats GROUP BY record), st AS (SELECT record, avg(step) AS ms FROM a GROUP BY record),
g AS (SELECT record, level, span, count(*) AS n, 60 / median(CASE WHEN dt > 0 THEN dt END) AS rate, 1000 * sqrt(avg(ddt * ddt)) AS rmssd, coalesce(stddev_pop(dt) / nullif(avg(dt), 0), 0) AS cv,
  60 * count(*) FILTER (WHERE kind = 'click') / (max(t) - min(t)) AS breaths, avg(CASE WHEN x < 0.35::DOUBLE * level THEN 1.0::DOUBLE ELSE 0 END) AS low, avg(CASE WHEN step > 6 * ms THEN 1.0::DOUBLE ELSE 0 END) AS burst
  FROM d JOIN mid USING (record) JOIN st USING (record) GROUP BY record, level, span),
f AS (SELECT record, n, round(rate, 6) AS rate_bpm, round(rmssd, 6) AS rmssd_ms, round(cv, 6) AS cv, round(breaths, 6) AS breaths, round(span / (abs(level) + 1e-8::DOUBLE), 6) AS perfusion, round(low, 6) AS low_share, round(burst, 6) AS burst_share FROM g WHERE n >= 3)"""


def _flags(*tests: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, n in tests) + "], lambda z: z IS NOT NULL)"


@query("session_features", f"{_FEATURES} SELECT * FROM f")
def session_features(spark, sf_dir):
    return op.session_features(beats(spark, sf_dir), "click")


@query("rest_screen", f"""{_FEATURES}, r AS (SELECT record, {_flags(("rate_bpm < 65", "slow_pulse"), ("rmssd_ms > 35", "high_variability"), ("breaths BETWEEN 8 AND 20", "plausible_breathing"), ("perfusion > 3", "variable_perfusion"))} AS fl FROM f)
SELECT record, array_to_string(fl, ',') AS flags, CASE WHEN len(fl) >= 2 THEN 'rest_compatible' ELSE 'wake_or_unclear' END AS state FROM r""")
def rest_screen(spark, sf_dir):
    return op.rest_screen(session_features(spark, sf_dir))


@query("shock_screen", f"""{_FEATURES}, r AS (SELECT record, round(CASE WHEN perfusion < 3 THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN low_share > 0.45 THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN rate_bpm > 110 THEN 0.5::DOUBLE ELSE 0 END, 6) AS score,
  {_flags(("perfusion < 3", "low_perfusion"), ("low_share > 0.45", "many_low_pulses"), ("rate_bpm > 110", "fast_pulse"))} AS fl FROM f)
SELECT record, score, array_to_string(fl, ',') AS flags, CASE WHEN score >= 1.2 THEN 'elevated' ELSE 'low' END AS risk FROM r""")
def shock_screen(spark, sf_dir):
    return op.shock_screen(session_features(spark, sf_dir), low_perfusion=3.0)


@query("bed_sleep_screen", f"""{_FEATURES}, r AS (SELECT record, round(CASE WHEN burst_share <= 0.08 THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN rate_bpm BETWEEN 40 AND 85 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN breaths BETWEEN 8 AND 24 THEN 0.25::DOUBLE ELSE 0 END
  + CASE WHEN cv < 0.25 THEN 0.15::DOUBLE ELSE 0 END, 6) AS score FROM f) SELECT record, score, CASE WHEN score >= 0.65 THEN 'quiet_rest' ELSE 'wake_or_unclear' END AS state FROM r""")
def bed_sleep_screen(spark, sf_dir):
    return op.bed_sleep_screen(session_features(spark, sf_dir))


@query("bcg_pressure_variation", f"{_FEATURES} SELECT record, 120.0::DOUBLE AS systolic, 80.0::DOUBLE AS diastolic, round(tanh(2 * (low_share - 0.25::DOUBLE)), 6) AS variation FROM f")
def bcg_pressure_variation(spark, sf_dir):
    return op.pressure_variation(session_features(spark, sf_dir), 120, 80)


@query("apnea_evidence", f"""WITH {BEATS_SQL}, d AS (SELECT record, t - lag(t) OVER (PARTITION BY record ORDER BY idx) AS dt FROM beats), o AS (SELECT record, dt, CASE WHEN dt BETWEEN 0.25 AND 3 THEN dt END AS k FROM d WHERE dt IS NOT NULL),
g AS (SELECT record, count(*) AS n, count(k) AS clean, count(k) / count(*)::DOUBLE AS ratio, stddev_pop(k) / nullif(avg(k), 0) AS cv, max(k) - min(k) AS rng FROM o GROUP BY record),
l AS (SELECT *, {_flags(("cv > 0.1", "variable_intervals"), ("rng > 0.45", "wide_range"))} AS e, {_flags(("ratio < 0.85", "many_removed"), ("clean < 20", "few_intervals"))} AS q FROM g)
SELECT record, n, round(ratio, 6) AS clean_ratio, round(cv, 6) AS cv, round(rng, 6) AS range_s, array_to_string(e, ',') AS evidence, array_to_string(q, ',') AS reliability,
  CASE WHEN len(q) = 2 THEN 'unreliable' WHEN len(e) = 2 THEN 'elevated' WHEN len(e) = 1 THEN 'borderline' ELSE 'low' END AS risk FROM l""")
def apnea_evidence(spark, sf_dir):
    return op.apnea_evidence(beats(spark, sf_dir), 0.25, 3.0)


@query("method_cascade", f"""WITH {BEATS_SQL}, m AS (SELECT record, 0 AS nth, 'purchases' AS method, median(x) AS v FROM beats WHERE kind = 'purchase' GROUP BY record HAVING count(*) >= 10
  UNION ALL SELECT record, 1, 'clicks', median(x) FROM beats WHERE kind = 'click' GROUP BY record HAVING count(*) >= 10 UNION ALL SELECT record, 2, 'all', median(x) FROM beats GROUP BY record),
r AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY nth) AS k FROM m WHERE v IS NOT NULL) SELECT record, method, round(v, 6) AS value FROM r WHERE k = 1""")
def method_cascade(spark, sf_dir):
    rows = beats(spark, sf_dir)
    of = lambda d, least: d.groupBy("record").agg(F.median("x").alias("value"), F.count("*").alias("n")).where(F.col("n") >= least)
    return op.cascade(("purchases", of(rows.where("kind = 'purchase'"), 10)), ("clicks", of(rows.where("kind = 'click'"), 10)), ("all", of(rows, 1)))


_Q = (1, 5, 10, 25, 50, 75, 90, 95, 99)


@query("oximetry_features", f"""WITH {OXIMETRY_SQL}, b AS (SELECT record, quantile_cont(spo2, 0.9) AS base FROM oximetry GROUP BY record),
s AS (SELECT o.*, base, coalesce(spo2 - lag(spo2) OVER w, 0) AS step, spo2 <= base - 3 AS low, row_number() OVER w AS nth FROM oximetry o JOIN b USING (record) WINDOW w AS (PARTITION BY o.record ORDER BY idx)),
i AS (SELECT record, nth - row_number() OVER (PARTITION BY record ORDER BY idx) AS island FROM s WHERE low), e AS (SELECT record, count(*) AS events FROM (SELECT record, island FROM i GROUP BY record, island HAVING count(*) >= 2) GROUP BY record),
g AS (SELECT record, count(*) AS n, round(base, 6) AS base, round(avg(spo2), 6) AS mean, round(stddev_pop(spo2), 6) AS sd, round(min(spo2), 6) AS least, round(max(spo2), 6) AS most,
  {", ".join(f"round(avg(CASE WHEN spo2 < {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS below_{k}" for k in (95, 93, 90, 88, 85))}, round(avg(CASE WHEN low THEN 1.0::DOUBLE ELSE 0 END), 6) AS low_share, round(avg(step), 6) AS step_mean,
  round(stddev_pop(step), 6) AS step_sd, round(quantile_cont(abs(step), 0.95), 6) AS step_p95, round(avg(CASE WHEN abs(step) > 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS big_steps, round(max(spo2) - min(spo2), 6) AS range,
  {", ".join(f"round(quantile_cont(spo2, {p / 100}), 6) AS p{p:02d}" for p in _Q)} FROM s GROUP BY record, base)
SELECT g.*, coalesce(events, 0) AS events, round(coalesce(events, 0) / (n / 3600.0::DOUBLE), 6) AS events_per_hour FROM g LEFT JOIN e USING (record)""")
def oximetry_features(spark, sf_dir):
    return op.saturation_features(oximetry(spark, sf_dir), seconds=2.0)


@query("clipped_signal", f"""WITH {SAMPLES_SQL}, e AS (SELECT record, quantile_cont(x, 0.005) AS lo, quantile_cont(x, 0.995) AS hi FROM samples GROUP BY record)
SELECT record, idx, round(CASE WHEN hi > lo THEN least(greatest(x, lo), hi) ELSE x END, 6) AS x FROM samples JOIN e USING (record)""")
def clipped_signal(spark, sf_dir):
    return op.clipped(samples(spark, sf_dir)).select("record", "idx", r6("x").alias("x"))


@query("acc_gravity", f"""WITH {SAMPLES_SQL}, a AS (SELECT record, idx // 3 AS i, idx % 3 AS axis, x FROM samples), m AS (SELECT record, i, sqrt(sum(x * x)) AS m FROM a GROUP BY record, i), b AS (SELECT record, median(m) AS med, (max(i) + 1) / 2 AS half FROM m GROUP BY record),
h AS (SELECT record, axis, avg(x) FILTER (WHERE i < half) AS a, avg(x) FILTER (WHERE i >= half) AS b FROM a JOIN b USING (record) GROUP BY record, axis),
d AS (SELECT record, sum(a * b) AS ab, sqrt(sum(a * a)) AS na, sqrt(sum(b * b)) AS nb FROM h GROUP BY record)
SELECT record, round(med, 6) AS magnitude, round(CASE WHEN med BETWEEN 5 AND 15 THEN 9.80665::DOUBLE WHEN med BETWEEN 0.5 AND 1.5 THEN 1.0::DOUBLE ELSE greatest(med, 1e-6::DOUBLE) END, 6) AS scale,
  round(CASE WHEN na > 1e-12 AND nb > 1e-12 THEN degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ab / (na * nb))))) END, 6) AS turn_degrees FROM b JOIN d USING (record)""")
def acc_gravity(spark, sf_dir):
    axes = samples(spark, sf_dir).select("record", F.floor(F.col("idx") / 3).alias("i"), (F.col("idx") % 3).alias("axis"), "x")
    return op.gravity(axes)


_CHANNELS = SAMPLES_SQL + ", ch AS (SELECT record, idx // 16 AS channel, idx % 16 AS idx, x FROM samples)"
_CHANNEL_FEATURES = f"""WITH {_CHANNELS}, mi AS (SELECT record, channel, median(x) AS mid, stddev_pop(x) AS sd FROM ch GROUP BY record, channel),
c AS (SELECT record, channel, idx, x - mid AS x, greatest(0.02::DOUBLE * sd, 1e-7::DOUBLE) AS thr FROM ch JOIN mi USING (record, channel)),
d AS (SELECT *, lag(x) OVER w AS bf, x - lag(x) OVER w AS d FROM c WINDOW w AS (PARTITION BY record, channel ORDER BY idx)), e AS (SELECT *, lag(d) OVER (PARTITION BY record, channel ORDER BY idx) AS e, x - avg(x) OVER (PARTITION BY record, channel) AS z FROM d),
cf AS (SELECT record, channel, round(sqrt(avg(x * x)), 6) AS rms, round(avg(abs(x)), 6) AS mav, round(sum(abs(d)), 6) AS length, round(var_pop(x), 6) AS variance, round(avg(abs(d)), 6) AS step, round(avg(CASE WHEN abs(x) > thr THEN 1.0::DOUBLE ELSE 0 END), 6) AS duty,
  round(count(*) FILTER (WHERE x * bf < 0 AND abs(x - bf) > thr) / count(*)::DOUBLE, 6) AS crossings, round(count(*) FILTER (WHERE d * e < 0 AND abs(d - e) > thr) / greatest(count(e), 1)::DOUBLE, 6) AS turns,
  {", ".join(f"round(quantile_cont(abs(x), {p / 100}), 6) AS abs_p{p}" for p in (50, 75, 90, 95))}, round(avg(z ** 3) / avg(z ** 2) ** 1.5, 6) AS skewness, round(avg(z ** 4) / avg(z ** 2) ** 2 - 3, 6) AS kurtosis FROM e GROUP BY record, channel)"""


def _channels(spark, sf_dir):
    return samples(spark, sf_dir).select("record", F.floor(F.col("idx") / 16).alias("channel"), (F.col("idx") % 16).alias("idx"), "x")


@query("emg_channel_features", f"{_CHANNEL_FEATURES} SELECT * FROM cf")
def emg_channel_features(spark, sf_dir):
    return op.channel_features(_channels(spark, sf_dir))


@query("emg_channel_balance", f"""WITH {_CHANNELS}, r AS (SELECT record, channel, sqrt(avg(x * x)) + 1e-12::DOUBLE AS rms FROM ch GROUP BY record, channel)
SELECT record, round(max(rms) / min(rms), 6) AS ratio, round(stddev_pop(rms) / avg(rms), 6) AS variation, min(struct_pack(v := -rms, c := channel)).c AS strongest FROM r GROUP BY record""")
def emg_channel_balance(spark, sf_dir):
    return op.channel_balance(_channels(spark, sf_dir))


_NORMALIZED = ["rms", "mav", "length", "variance", "step", "duty", "crossings", "turns"]


@query("emg_normalized_channels", f"""{_CHANNEL_FEATURES}, lg AS (SELECT record, channel, unnest([{", ".join(f"'{n}'" for n in _NORMALIZED)}]) AS feature, unnest([{", ".join(_NORMALIZED)}]) AS value FROM cf)
SELECT record, channel, feature, round(value / (avg(abs(value)) OVER (PARTITION BY record, feature) + 1e-6::DOUBLE), 6) AS relative, round(ln(1 + abs(value)), 6) AS log FROM lg""")
def emg_normalized_channels(spark, sf_dir):
    return op.normalized_channels(emg_channel_features(spark, sf_dir), _NORMALIZED)


@query("emg_column_features", f"""WITH {_CHANNELS}, d AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY record, channel ORDER BY idx)) AS d FROM ch)
SELECT record, channel, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, round(min(x), 6) AS least, round(max(x), 6) AS most, {", ".join(f"round(quantile_cont(x, {p / 100}), 6) AS p{p}" for p in (25, 50, 75))},
  round(sqrt(avg(x * x) + 1e-12::DOUBLE), 6) AS rms, round(coalesce(avg(d), 0), 6) AS step FROM d GROUP BY record, channel""")
def emg_column_features(spark, sf_dir):
    return op.column_features(_channels(spark, sf_dir))
