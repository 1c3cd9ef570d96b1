"""Queries that need numeric kernels; tests hold them against formulas and synthetic signals."""

from ..operators import cardiac, intervals, neuro, spectral as op
from ..sources.tables import SAMPLES_SQL, beats, table
from . import query
from .rhythm import CLEAN
from pyspark.sql import functions as F

RATE = 64.0

#: The windowed periodogram of 64 samples in SQL, term by term: record, k (hertz at 64 a second), p.
PERIODOGRAM_SQL = SAMPLES_SQL + """, mu AS (SELECT record, avg(x) AS mu FROM samples GROUP BY record), fk AS (SELECT unnest(range(0, 33)) AS k),
ft AS (SELECT s.record, k, sum((x - mu) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * idx / 64)) * cos(2 * pi() * k * idx / 64)) AS c, sum((x - mu) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * idx / 64)) * sin(2 * pi() * k * idx / 64)) AS d
  FROM samples s JOIN mu USING (record) CROSS JOIN fk GROUP BY s.record, k),
pg AS (SELECT record, k, (c * c + d * d) / (64 * 24) * CASE WHEN k BETWEEN 1 AND 31 THEN 2 ELSE 1 END AS p FROM ft)"""
#: The size of the analytic signal of 64 samples in SQL: record, idx, x (centred), e.


def envelope_sql(centre: str) -> str:
    return f"""md AS (SELECT record, {centre}(x) AS md FROM samples GROUP BY record), ce AS (SELECT s.record, idx, x - md AS x FROM samples s JOIN md USING (record)), hk AS (SELECT unnest(range(1, 32)) AS k),
cs AS (SELECT record, k, sum(x * cos(2 * pi() * k * idx / 64)) AS c, sum(x * sin(2 * pi() * k * idx / 64)) AS d FROM ce CROSS JOIN hk GROUP BY record, k),
hi AS (SELECT e.record, e.idx, any_value(x) AS x, 2 / 64.0::DOUBLE * sum(c * sin(2 * pi() * k * idx / 64) - d * cos(2 * pi() * k * idx / 64)) AS h FROM ce e JOIN cs USING (record) GROUP BY e.record, e.idx),
en AS (SELECT record, idx, x, sqrt(x * x + h * h) AS e FROM hi)"""


def _trapezoid(low: int, high: int) -> str:
    """The integral over bins low to high, a bin wide one."""
    return f"(sum(p) FILTER (WHERE k BETWEEN {low} AND {high}) - (sum(p) FILTER (WHERE k = {low}) + sum(p) FILTER (WHERE k = {high})) / 2)"


#: Of each signal: median, robust deviation, percentiles and largest size; and its steps.
LEVELS_SQL = """lv AS (SELECT record, median(x) AS med, quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99, max(abs(x)) AS top, stddev_pop(x) AS sd, median(abs(x)) AS mid FROM samples GROUP BY record),
rb AS (SELECT s.record, 1.4826::DOUBLE * median(abs(x - med)) + 1e-8::DOUBLE AS s FROM samples s JOIN lv USING (record) GROUP BY s.record),
sx AS (SELECT s.record, idx, x, abs(x - lag(x) OVER (PARTITION BY s.record ORDER BY idx)) AS step, lv.* EXCLUDE (record), rb.s FROM samples s JOIN lv USING (record) JOIN rb USING (record))"""


def spectrum_sql(edges: tuple[float, ...]) -> str:
    bands = ", ".join(f"round(coalesce(sum(p) FILTER (WHERE k >= {a} AND k < {b}), 0) / (sum(p) FILTER (WHERE k >= {edges[0]} AND k < {edges[-1]}) + 1e-12::DOUBLE), 6) AS band_{i}" for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)))
    return f"""WITH {PERIODOGRAM_SQL}, {envelope_sql("median")}, cu AS (SELECT *, sum(p) OVER (PARTITION BY record ORDER BY k) AS c, sum(p) OVER (PARTITION BY record) AS t FROM pg),
sp AS (SELECT record, round(min(k) FILTER (WHERE c >= t / 2)::DOUBLE, 6) AS median_hz, round(sum(p / (t + 1e-12::DOUBLE) * k), 6) AS mean_hz, round(min(struct_pack(v := -p, k := k)).k::DOUBLE, 6) AS peak_hz,
  round(-sum(p / (t + 1e-12::DOUBLE) * log2(p / (t + 1e-12::DOUBLE) + 1e-12::DOUBLE)) / log2(33), 6) AS entropy, {bands} FROM cu GROUP BY record),
ev AS (SELECT record, round(sqrt(avg(x * x) + 1e-12::DOUBLE), 6) AS rms, round(max(abs(x)) / sqrt(avg(x * x) + 1e-12::DOUBLE), 6) AS crest, round(stddev_pop(e) / (avg(e) + 1e-12::DOUBLE), 6) AS envelope_cv, round(quantile_cont(e, 0.95) / (median(e) + 1e-12::DOUBLE), 6) AS envelope_p95 FROM en GROUP BY record)
SELECT * FROM sp JOIN ev USING (record)"""


def signals(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record"), F.col("embedding").alias("values"))


def pressure_signals(spark, sf_dir):
    """Vectors scaled to pressures of about 90 +- 40."""
    return signals(spark, sf_dir).withColumn("values", F.transform("values", lambda v: 90 + 300 * v))


@query("eeg_bandpower", f"""WITH {PERIODOGRAM_SQL}, bd AS (SELECT * FROM (VALUES ('delta', 1, 3), ('theta', 4, 7), ('alpha', 8, 12), ('beta', 13, 29), ('gamma', 30, 32)) AS t(band, lo, hi)),
bp AS (SELECT record, band, sum(p) - (sum(p) FILTER (WHERE k = lo) + sum(p) FILTER (WHERE k = hi)) / 2 AS v FROM pg JOIN bd ON k BETWEEN lo AND hi GROUP BY record, band),
w AS (SELECT record, sum(v) FILTER (WHERE band = 'delta') AS d, sum(v) FILTER (WHERE band = 'theta') AS t, sum(v) FILTER (WHERE band = 'alpha') AS a, sum(v) FILTER (WHERE band = 'beta') AS b, sum(v) FILTER (WHERE band = 'gamma') AS g, greatest(sum(v), 1e-12::DOUBLE) AS s FROM bp GROUP BY record)
SELECT record, round(d, 6) AS delta, round(t, 6) AS theta, round(a, 6) AS alpha, round(b, 6) AS beta, round(g, 6) AS gamma, round(s, 6) AS total,
  CASE WHEN d / s > 0.45 THEN 'deep' WHEN t / s > 0.30 AND a / s < 0.20 THEN 'light' WHEN a / s > 0.25 OR b / s > 0.25 THEN 'wake' ELSE 'uncertain' END AS stage FROM w""")
def eeg_bandpower(spark, sf_dir):
    return op.bandpower(signals(spark, sf_dir), RATE)


@query("spectrogram_features", f"""WITH {SAMPLES_SQL}, g AS (SELECT record, s, idx - s AS i, x FROM samples CROSS JOIN (VALUES (0), (16), (32)) AS t(s) WHERE idx >= s AND idx < s + 32), m AS (SELECT record, s, avg(x) AS mu FROM g GROUP BY record, s), k AS (SELECT unnest(range(0, 17)) AS k),
f AS (SELECT record, s, k, sum((x - mu) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 32)) * cos(2 * pi() * k * i / 32)) AS c, sum((x - mu) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 32)) * sin(2 * pi() * k * i / 32)) AS d FROM g JOIN m USING (record, s) CROSS JOIN k GROUP BY record, s, k),
p AS (SELECT record, s, k, (c * c + d * d) / (64 * 12) AS p FROM f), av AS (SELECT record, k, avg(p) AS p FROM p GROUP BY record, k), q AS (SELECT record, k, p / greatest(sum(p) OVER (PARTITION BY record), 1e-12::DOUBLE) AS q, sum(p) OVER (PARTITION BY record ORDER BY k) / greatest(sum(p) OVER (PARTITION BY record), 1e-12::DOUBLE) AS c FROM av),
u AS (SELECT record, sum(p) AS t FROM p GROUP BY record, s), v AS (SELECT record, round(stddev_pop(t) / greatest(avg(t), 1e-12::DOUBLE), 6) AS temporal_cv FROM u GROUP BY record)
SELECT record, 3 AS bins, round(sum(q * k * 2), 6) AS centroid_hz, round(min(k * 2.0::DOUBLE) FILTER (WHERE c >= 0.85::DOUBLE - 1e-12::DOUBLE), 6) AS rolloff_hz, round(-sum(q * log2(greatest(q, 1e-12::DOUBLE))) / log2(17), 6) AS entropy, any_value(temporal_cv) AS temporal_cv
FROM q JOIN v USING (record) GROUP BY record""")
def spectrogram_features(spark, sf_dir):
    return op.spectrogram(signals(spark, sf_dir), RATE)


@query("bandpass_peaks")
def bandpass_peaks(spark, sf_dir):
    return op.bandpass_peaks(signals(spark, sf_dir), RATE, 2.0, 12.0)


@query("bcg_candidate_arbitration")
def bcg_candidate_arbitration(spark, sf_dir):
    return op.candidate_arbitration(signals(spark, sf_dir), RATE, [(2.0, 8.0), (3.0, 12.0), (4.0, 16.0), (5.0, 20.0), (6.0, 24.0)])


@query("pcg_cycle", f"""WITH {SAMPLES_SQL}, {envelope_sql("avg")}, z AS (SELECT record, idx, e - avg(e) OVER (PARTITION BY record) AS e FROM en), v AS (SELECT record, sum(e * e) AS v FROM z GROUP BY record),
r AS (SELECT a.record, b.idx - a.idx AS lag, sum(a.e * b.e) AS r FROM z a JOIN z b ON a.record = b.record AND b.idx - a.idx BETWEEN 6 AND 38 GROUP BY 1, 2), t AS (SELECT record, min(struct_pack(v := -r, lag := lag)) AS t FROM r GROUP BY record)
SELECT record, round(t.lag / 64.0::DOUBLE, 6) AS cycle_s, round(-t.v / greatest(v.v, 1e-12::DOUBLE), 6) AS periodicity FROM t JOIN v USING (record)""")
def pcg_cycle(spark, sf_dir):
    return op.dominant_cycle(signals(spark, sf_dir), RATE, 0.1, 0.6)


@query("emg_median_frequency", f"""WITH {PERIODOGRAM_SQL}, c AS (SELECT *, sum(p) OVER (PARTITION BY record ORDER BY k) AS c, sum(p) OVER (PARTITION BY record) AS t FROM pg WHERE k BETWEEN 2 AND 30), m AS (SELECT record, min(k) FILTER (WHERE c >= t / 2) AS k FROM c GROUP BY record)
SELECT record, round(k::DOUBLE, 6) AS median_hz, k < 32 / 3.0 AS fatigue FROM m""")
def emg_median_frequency(spark, sf_dir):
    return op.median_frequency(signals(spark, sf_dir), RATE, 2.0, 30.0)


@query("hrv_frequency", CLEAN + """, hb AS (SELECT record, t, 1000 * dt AS v, min(t) OVER (PARTITION BY record) AS t0, max(t) OVER (PARTITION BY record) AS t1, count(*) OVER (PARTITION BY record) AS n, lead(t) OVER o AS t2, lead(1000 * dt) OVER o AS v2 FROM clean WINDOW o AS (PARTITION BY record ORDER BY t, dt)),
hg AS (SELECT record, t, v, t0, t2, v2, ceil((t1 - t0) * 4)::BIGINT AS m, unnest(generate_series(ceil((t - t0) * 4)::BIGINT, ceil((t2 - t0) * 4)::BIGINT - 1)) AS g FROM hb WHERE n >= 8 AND t1 - t0 >= 30 AND t2 > t),
hs AS (SELECT record, g // 128 - d AS s, g - 128 * (g // 128 - d) AS i, least(m, 256) AS m, v + (v2 - v) * (t0 + g / 4.0::DOUBLE - t) / (t2 - t) AS x FROM hg CROSS JOIN (VALUES (0), (1)) AS q(d) WHERE g // 128 = d OR (g // 128 > d AND (g // 128 - d) * 128 + 256 <= m)),
hm AS (SELECT *, avg(x) OVER (PARTITION BY record, s) AS mu FROM hs), hk AS (SELECT unnest(range(1, 60)) AS k),
hf AS (SELECT record, s, k, m, sum((x - mu) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / m)) * cos(2 * pi() * k * i / m)) AS c, sum((x - mu) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / m)) * sin(2 * pi() * k * i / m)) AS d FROM hm JOIN hk ON 4.0::DOUBLE * k / m < 0.4::DOUBLE AND 4.0::DOUBLE * k / m >= 0.04::DOUBLE GROUP BY ALL),
hp AS (SELECT record, k, 4.0::DOUBLE / m AS w, 4.0::DOUBLE * k / m < 0.15::DOUBLE AS low, avg((c * c + d * d) * 2 / (4 * 0.375::DOUBLE * m)) AS p FROM hf GROUP BY ALL), hu AS (SELECT record, low, w * (sum(p) - (min(struct_pack(k := k, p := p)).p + max(struct_pack(k := k, p := p)).p) / 2) AS v FROM hp GROUP BY record, low, w),
hr AS (SELECT record, sum(v) FILTER (WHERE low) AS lf, sum(v) FILTER (WHERE NOT low) AS hf FROM hu GROUP BY record)
SELECT a.record, a.n, round(lf, 6) AS lf, round(hf, 6) AS hf, round(lf / nullif(hf, 0), 6) AS lf_hf FROM (SELECT record, count(*) AS n FROM clean GROUP BY record) a LEFT JOIN hr USING (record)""")
def hrv_frequency(spark, sf_dir):
    return op.hrv_frequency(intervals.clean_intervals(beats(spark, sf_dir)))


@query("image_path_trace")
def image_path_trace(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    mask = line.select((F.col("l_suppkey") % 97).alias("image"), (F.col("l_partkey") % 60).alias("x"), (F.col("l_orderkey") % 40).alias("y")).distinct()
    return op.minimum_path(mask)


@query("image_median_trace", "SELECT l_suppkey % 97 AS image, l_partkey % 60 AS x, median(l_orderkey % 40) AS y, count(*) AS pixels FROM lineitem GROUP BY 1, 2")
def image_median_trace(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    mask = line.select((F.col("l_suppkey") % 97).alias("image"), (F.col("l_partkey") % 60).alias("x"), (F.col("l_orderkey") % 40).alias("y"))
    return mask.groupBy("image", "x").agg(F.median("y").alias("y"), F.count("*").alias("pixels"))


@query("eeg_seizure_screen", f"""WITH {PERIODOGRAM_SQL}, {LEVELS_SQL}, o AS (SELECT record, idx, abs(x - med) > 6 * s AS hot FROM sx), e AS (SELECT record, hot AND NOT coalesce(lag(hot) OVER (PARTITION BY record ORDER BY idx), false) AS up FROM o),
n AS (SELECT record, count(*) FILTER (WHERE up) AS spikes FROM e GROUP BY record), f AS (SELECT record, {_trapezoid(13, 28)} / greatest({_trapezoid(1, 28)}, 1e-12::DOUBLE) AS fast FROM pg GROUP BY record)
SELECT record, spikes, round(spikes * 60.0::DOUBLE, 6) AS spikes_per_min, round(fast, 6) AS fast_ratio, CASE WHEN spikes * 60 > 12 OR fast > 0.45 THEN 'possible' ELSE 'none' END AS risk FROM n JOIN f USING (record)""")
def eeg_seizure_screen(spark, sf_dir):
    return neuro.seizure_screen(signals(spark, sf_dir), RATE)


@query("eeg_drowsiness", f"""WITH {PERIODOGRAM_SQL}, f AS (SELECT record, {_trapezoid(1, 3)} AS d, {_trapezoid(4, 7)} AS t, {_trapezoid(8, 12)} AS a, greatest({_trapezoid(1, 28)}, 1e-12::DOUBLE) AS w FROM pg GROUP BY record)
SELECT record, round(t / (a + 1e-12::DOUBLE), 6) AS theta_alpha, round((t + d) / w, 6) AS slow_ratio, CASE WHEN t / (a + 1e-12::DOUBLE) > 1.2 OR (t + d) / w > 0.55 THEN 'drowsy' ELSE 'alert' END AS hint FROM f""")
def eeg_drowsiness(spark, sf_dir):
    return neuro.drowsiness(signals(spark, sf_dir), RATE)


@query("eeg_artifacts", f"""WITH {PERIODOGRAM_SQL}, {LEVELS_SQL}, e AS (SELECT record, avg(CASE WHEN abs(x - med) > 8 * s THEN 1.0::DOUBLE ELSE 0 END) AS extreme FROM sx GROUP BY record),
f AS (SELECT record, {_trapezoid(20, 28)} / ({_trapezoid(0, 32)} + 1e-12::DOUBLE) AS fast FROM pg GROUP BY record)
SELECT record, round(extreme, 6) AS extreme, round(fast, 6) AS fast_ratio, ['low', 'moderate', 'high'][(extreme > 0.01)::INT + (fast > 0.35)::INT + 1] AS level FROM e JOIN f USING (record)""")
def eeg_artifacts(spark, sf_dir):
    return neuro.brain_artifacts(signals(spark, sf_dir), 100.0)


@query("emg_bursts")
def emg_bursts(spark, sf_dir):
    return neuro.muscle_bursts(signals(spark, sf_dir), RATE)


@query("eda_arousal")
def eda_arousal(spark, sf_dir):
    return neuro.arousal(signals(spark, sf_dir), 4.0)


@query("resp_breaths")
def resp_breaths(spark, sf_dir):
    return neuro.breathing(signals(spark, sf_dir), 2.0)


@query("resp_events")
def resp_events(spark, sf_dir):
    return neuro.breath_events(signals(spark, sf_dir), 2.0, 2.0)


@query("acc_activity", f"""WITH {SAMPLES_SQL}, {LEVELS_SQL}, g AS (SELECT record, x / CASE WHEN mid > 5 THEN 9.80665::DOUBLE WHEN mid > 0.5 THEN 1.0::DOUBLE ELSE greatest(mid, 1e-8::DOUBLE) END AS g, coalesce(step, 0) / CASE WHEN mid > 5 THEN 9.80665::DOUBLE WHEN mid > 0.5 THEN 1.0::DOUBLE ELSE greatest(mid, 1e-8::DOUBLE) END * 16 AS j FROM sx),
a AS (SELECT record, stddev_pop(g) AS sd, quantile_cont(g, 0.95) - quantile_cont(g, 0.05) AS span, quantile_cont(j, 0.95) AS jerk FROM g GROUP BY record)
SELECT record, round(sd, 6) AS sd, round(span, 6) AS span, round(jerk, 6) AS jerk_p95, CASE WHEN sd > 0.35 OR jerk > 3 THEN 'high' WHEN sd > 0.08 OR jerk > 0.8 THEN 'moderate' ELSE 'low' END AS activity FROM a""")
def acc_activity(spark, sf_dir):
    return neuro.motion_summary(signals(spark, sf_dir), 16.0)


@query("acc_impacts")
def acc_impacts(spark, sf_dir):
    return neuro.impacts(signals(spark, sf_dir), 16.0)


@query("bcg_rhythm")
def bcg_rhythm(spark, sf_dir):
    return cardiac.ballisto_rhythm(signals(spark, sf_dir), 16.0)


@query("bcg_presence")
def bcg_presence(spark, sf_dir):
    return cardiac.bed_presence(signals(spark, sf_dir), 16.0)


@query("bcg_respiration")
def bcg_respiration(spark, sf_dir):
    return cardiac.respiration_from_motion(signals(spark, sf_dir), 2.5)


@query("abp_pulses")
def abp_pulses(spark, sf_dir):
    return cardiac.pressure_pulses(pressure_signals(spark, sf_dir), 8.0)


@query("ppg_artifacts", f"""WITH {PERIODOGRAM_SQL}, {LEVELS_SQL}, a AS (SELECT record, avg(CASE WHEN step <= greatest((p95 - p5) * 1e-4::DOUBLE, 1e-8::DOUBLE) THEN 1.0::DOUBLE WHEN step IS NOT NULL THEN 0 END) AS flat,
  CASE WHEN any_value(p95 - p5) > 0 THEN avg(CASE WHEN x <= p1 + (p95 - p5) * 1e-3::DOUBLE OR x >= p99 - (p95 - p5) * 1e-3::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) ELSE 1 END AS sat FROM sx GROUP BY record),
f AS (SELECT record, {_trapezoid(0, 2)} / ({_trapezoid(0, 32)} + 1e-12::DOUBLE) AS wander, {_trapezoid(23, 32)} / ({_trapezoid(0, 32)} + 1e-12::DOUBLE) AS noise FROM pg GROUP BY record)
SELECT record, round(flat, 6) AS flat, round(sat, 6) AS saturated, round(wander, 6) AS wander, round(noise, 6) AS noise, round(least(1, least(0.35::DOUBLE, 2 * flat) + least(0.25::DOUBLE, 1.5::DOUBLE * greatest(0, sat - 0.08::DOUBLE))
  + least(0.25::DOUBLE, 0.8::DOUBLE * greatest(0, wander - 0.45::DOUBLE)) + least(0.2::DOUBLE, 0.8::DOUBLE * greatest(0, noise - 0.2::DOUBLE))), 6) AS score FROM a JOIN f USING (record)""")
def ppg_artifacts(spark, sf_dir):
    return cardiac.pulse_artifacts(signals(spark, sf_dir), 8.0)


@query("ppg_amplitudes")
def ppg_amplitudes(spark, sf_dir):
    return cardiac.pulse_amplitudes(signals(spark, sf_dir), 8.0)


@query("scg_quality", f"""WITH {PERIODOGRAM_SQL}, {LEVELS_SQL}, w AS (SELECT record, idx // 16 AS w, stddev_pop(x) AS ws, any_value(sd) AS sd, any_value(p95 - p5) AS span FROM sx GROUP BY record, idx // 16), a AS (SELECT record, avg(CASE WHEN ws < 0.05::DOUBLE * sd THEN 1.0::DOUBLE ELSE 0 END) AS flat, any_value(span) AS span FROM w GROUP BY record),
f AS (SELECT record, {_trapezoid(1, 28)} / ({_trapezoid(1, 28)} + 1e-12::DOUBLE) AS heart FROM pg GROUP BY record), r AS (SELECT *, (span < 0.1)::BIGINT + (flat > 0.1)::BIGINT + (heart < 0.25)::BIGINT AS reasons FROM a JOIN f USING (record))
SELECT record, round(heart, 6) AS cardiac, 0.0::DOUBLE AS motion, 0.0::DOUBLE AS fast, round(flat, 6) AS flat, reasons, CASE WHEN reasons > 0 THEN 'bad' WHEN heart < 0.45 THEN 'moderate' ELSE 'good' END AS quality FROM r""")
def scg_quality(spark, sf_dir):
    return cardiac.seismo_quality(signals(spark, sf_dir), RATE)


@query("pcg_heart_sounds")
def pcg_heart_sounds(spark, sf_dir):
    return cardiac.heart_sounds(signals(spark, sf_dir), 20.0)


@query("ecg_artifacts", f"""WITH {PERIODOGRAM_SQL}, {LEVELS_SQL}, a AS (SELECT record, CASE WHEN any_value(top) > 0 THEN avg(CASE WHEN abs(x) >= 0.999::DOUBLE * top THEN 1.0::DOUBLE ELSE 0 END) ELSE 1 END AS sat, any_value(p95 - p5) AS span,
  avg(CASE WHEN step <= greatest(1e-4::DOUBLE * (p95 - p5), 1e-8::DOUBLE) THEN 1.0::DOUBLE WHEN step IS NOT NULL THEN 0 END) AS flat FROM sx GROUP BY record),
f AS (SELECT record, {_trapezoid(0, 32)} + 1e-12::DOUBLE AS t, sum(p) FILTER (WHERE k = 0) AS w, sum(p) FILTER (WHERE k >= 26) AS h, greatest(sum(p) FILTER (WHERE k = 26), sum(p) FILTER (WHERE k = 31)) AS m FROM pg GROUP BY record),
q AS (SELECT record, sat, flat, w / t AS wander, h / t AS fast, m / t AS mains, CASE WHEN sat > 0.05 THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN flat > 0.2 THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN w / t > 0.4 THEN 0.8::DOUBLE ELSE 1 END
  * CASE WHEN h / t > 0.35 THEN 0.7::DOUBLE ELSE 1 END * CASE WHEN m / t > 0.25 THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN span <= 1e-8 THEN 0.1::DOUBLE ELSE 1 END AS sqi FROM a JOIN f USING (record))
SELECT record, round(sat, 6) AS saturation, round(flat, 6) AS flat, round(wander, 6) AS wander, round(fast, 6) AS fast, round(mains, 6) AS mains, round(sqi, 6) AS sqi, CASE WHEN sqi >= 0.75 THEN 'good' WHEN sqi >= 0.45 THEN 'moderate' ELSE 'bad' END AS quality FROM q""")
def ecg_artifacts(spark, sf_dir):
    return cardiac.ecg_artifacts(signals(spark, sf_dir), 125.0)


@query("ecg_st")
def ecg_st(spark, sf_dir):
    return cardiac.st_features(signals(spark, sf_dir), 16.0)
