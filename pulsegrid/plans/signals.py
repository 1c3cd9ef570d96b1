"""Quality, artifact and distribution queries."""

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import quality as op
from ..operators import waveform as wave
from ..sources.tables import BEATS_SQL, SAMPLES_SQL, beats, samples
from . import query


@query("signal_quality", """
WITH e AS (SELECT user_id AS record, event_type AS kind, value AS x, isfinite(value) AS ok FROM events),
t AS (SELECT record, kind, ok, CASE WHEN ok THEN x END AS x, max(abs(CASE WHEN ok THEN x END)) OVER (PARTITION BY record, kind) AS top FROM e),
a AS (SELECT record, kind, count(*) AS n, avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END) AS fin, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) AS range,
  CASE WHEN max(top) = 0 THEN 1.0::DOUBLE ELSE avg(CASE WHEN abs(x) >= 0.999::DOUBLE * top THEN 1.0::DOUBLE ELSE 0 END) END AS clip FROM t GROUP BY record, kind)
SELECT record, kind, n, round(fin, 6) AS finite_ratio, round(range, 6) AS signal_range, round(clip, 6) AS clip_ratio,
  CASE WHEN fin < 0.99 OR range = 0 OR clip > 0.2 OR range IS NULL THEN 'bad' WHEN clip > 0.05 THEN 'moderate' ELSE 'good' END AS quality,
  CASE WHEN fin < 0.99 OR range = 0 OR clip > 0.2 OR range IS NULL THEN 0.2::DOUBLE WHEN clip > 0.05 THEN 0.6 ELSE 0.85 END AS confidence FROM a""")
def signal_quality(spark, sf_dir):
    return op.signal_quality(beats(spark, sf_dir).select("record", "kind", "x"), "record", "kind")


@query("artifact_flags", f"""WITH {BEATS_SQL},
s AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY record ORDER BY idx)) AS step, quantile_cont(x, 0.95) OVER (PARTITION BY record) - quantile_cont(x, 0.05) OVER (PARTITION BY record) AS range,
  stddev_pop(x) OVER (PARTITION BY record) AS sd, max(abs(x)) OVER (PARTITION BY record) AS top FROM beats),
a AS (SELECT record, any_value(range) AS range, avg(CASE WHEN abs(x) >= 0.999::DOUBLE * top THEN 1.0::DOUBLE ELSE 0 END) AS clip,
  coalesce(count(*) FILTER (WHERE step > greatest(5 * sd, 0.5 * range, 1e-8)) / nullif(count(step), 0)::DOUBLE, 0) AS jump FROM s GROUP BY record),
f AS (SELECT *, list_filter([CASE WHEN range <= 1e-8 THEN 'flatline' END, CASE WHEN clip > 0.05 THEN 'clipping' END, CASE WHEN jump > 0.01 THEN 'jumps' END], lambda x: x IS NOT NULL) AS fl FROM a)
SELECT record, round(range, 6) AS signal_range, round(clip, 6) AS clip_ratio, round(jump, 6) AS jump_ratio, array_to_string(fl, ',') AS flags,
  CASE WHEN len(fl) >= 2 OR range <= 1e-8 THEN 'high' WHEN len(fl) = 1 THEN 'moderate' ELSE 'low' END AS level FROM f""")
def artifact_flags(spark, sf_dir):
    return op.artifact_flags(beats(spark, sf_dir))


@query("distribution_moments", f"""WITH {SAMPLES_SQL},
m AS (SELECT *, median(x) OVER (PARTITION BY record) AS med, avg(x) OVER (PARTITION BY record) AS mu FROM samples)
SELECT record, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, round(avg((x - mu) ** 3) / stddev_pop(x) ** 3, 6) AS skewness,
  round(avg((x - mu) ** 4) / var_pop(x) ** 2 - 3, 6) AS kurtosis, round(quantile_cont(x, 0.25), 6) AS q25, round(any_value(med), 6) AS median,
  round(quantile_cont(x, 0.75), 6) AS q75, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(1.4826::DOUBLE * median(abs(x - med)), 6) AS mad FROM m GROUP BY record""")
def distribution_moments(spark, sf_dir):
    return op.distribution_moments(samples(spark, sf_dir))


@query("zero_crossings", f"""WITH {SAMPLES_SQL},
s AS (SELECT record, idx, sign(x - median(x) OVER (PARTITION BY record)) AS s FROM samples),
c AS (SELECT record, s * lag(s) OVER (PARTITION BY record ORDER BY idx) < 0 AS crossing FROM s)
SELECT record, count(*) FILTER (WHERE crossing) AS crossings, round(count(*) FILTER (WHERE crossing) / count(crossing)::DOUBLE, 6) AS rate FROM c GROUP BY record""")
def zero_crossings(spark, sf_dir):
    return op.zero_crossings(samples(spark, sf_dir))


@query("perfusion_windows", f"""WITH {BEATS_SQL},
b AS (SELECT record, idx - 1 AS idx, x, count(*) OVER (PARTITION BY record) AS n FROM beats),
w AS (SELECT b.record, g.w, x FROM b JOIN (SELECT unnest(generate_series(0, (SELECT max(n) FROM b)::BIGINT // 15)) AS w) g ON b.idx >= g.w * 15 AND b.idx < g.w * 15 + 30 AND g.w * 15 + 30 <= b.n),
e AS (SELECT record, w, (quantile_cont(x, 0.95) - quantile_cont(x, 0.05)) / (abs(median(x)) + 1e-3::DOUBLE) AS i FROM w GROUP BY record, w)
SELECT record, count(*) AS windows, round(median(i), 6) AS perfusion, round(coalesce(stddev_pop(i) / nullif(avg(i), 0), 0), 6) AS variability FROM e GROUP BY record""")
def perfusion_windows(spark, sf_dir):
    return op.perfusion_windows(beats(spark, sf_dir).withColumn("idx", F.col("idx") - 1))


@query("emg_time_features", f"""WITH {SAMPLES_SQL},
d AS (SELECT *, x - lag(x) OVER w AS d1, lead(x) OVER w - x AS d2, lag(x) OVER w AS px FROM samples WINDOW w AS (PARTITION BY record ORDER BY idx))
SELECT record, round(avg(abs(x)), 6) AS mav, round(sqrt(avg(x * x)), 6) AS rms, round(coalesce(sum(abs(d1)), 0), 6) AS waveform_length, round(var_pop(x), 6) AS variance,
  count(*) FILTER (WHERE x * px < 0) AS zero_crossings, count(*) FILTER (WHERE d1 * d2 < 0) AS slope_changes, round(sum(abs(x)), 6) AS iemg,
  count(*) FILTER (WHERE abs(d1) > 0.1) AS wilson FROM d GROUP BY record""")
def emg_time_features(spark, sf_dir):
    return wave.emg_time_features(samples(spark, sf_dir))


@query("coactivation", f"""WITH {SAMPLES_SQL},
c AS (SELECT record, idx % 16 AS step, idx // 16 AS channel, abs(x) AS a FROM samples),
t AS (SELECT *, median(a) OVER (PARTITION BY record, channel) + stddev_pop(a) OVER (PARTITION BY record, channel) AS thr FROM c),
n AS (SELECT record, step, count(*) FILTER (WHERE a > thr) AS active FROM t GROUP BY record, step)
SELECT record, round(avg(active), 6) AS mean_active, round(avg(CASE WHEN active >= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coactivation FROM n GROUP BY record""")
def coactivation(spark, sf_dir):
    rows = samples(spark, sf_dir).select("record", (F.col("idx") % 16).alias("idx"), F.floor(F.col("idx") / 16).alias("channel"), "x")
    return wave.coactivation(rows)


@query("eda_tonic_phasic", f"""WITH {SAMPLES_SQL},
w AS (SELECT record, idx, x, list_sort(list_concat(list(x) OVER w, list_transform(range(5 - len(list(x) OVER w)), lambda i: 0.0::DOUBLE))) AS near FROM samples
  WINDOW w AS (PARTITION BY record ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
t AS (SELECT record, near[3] AS tonic, x - near[3] AS phasic FROM w)
SELECT record, round(avg(tonic), 6) AS tonic_mean, round(stddev_pop(tonic), 6) AS tonic_sd, round(stddev_pop(phasic), 6) AS phasic_sd FROM t GROUP BY record""")
def eda_tonic_phasic(spark, sf_dir):
    return wave.tonic_phasic(samples(spark, sf_dir))


@query("slope_regression", f"WITH {SAMPLES_SQL} SELECT record, round(regr_slope(x, idx / 64.0::DOUBLE), 6) AS slope, round(regr_intercept(x, idx / 64.0::DOUBLE), 6) AS intercept FROM samples GROUP BY record")
def slope_regression(spark, sf_dir):
    return wave.slope(samples(spark, sf_dir), 64.0)


@query("hjorth", f"""WITH {SAMPLES_SQL},
a AS (SELECT *, x - lag(x) OVER (PARTITION BY record ORDER BY idx) AS d FROM samples),
b AS (SELECT *, d - lag(d) OVER (PARTITION BY record ORDER BY idx) AS dd FROM a),
v AS (SELECT record, var_pop(x) AS v0, var_pop(d) AS v1, var_pop(dd) AS v2 FROM b GROUP BY record)
SELECT record, round(v0, 6) AS activity, round(sqrt(v1 / v0), 6) AS mobility, round(sqrt(v2 / v1) / sqrt(v1 / v0), 6) AS complexity FROM v""")
def hjorth(spark, sf_dir):
    return wave.hjorth(samples(spark, sf_dir))


@query("sliding_windows", f"""WITH {BEATS_SQL}, n AS (SELECT record, count(*) AS n FROM beats GROUP BY record),
s AS (SELECT record, n, unnest(generate_series(0, n - 20, 10)) AS start FROM n WHERE n >= 20)
SELECT record, start, count(*) AS n, round(avg(x), 6) AS mean, round(max(x) - min(x), 6) AS span FROM s JOIN beats USING (record) WHERE idx - 1 >= start AND idx - 1 < start + 20 GROUP BY record, start""")
def sliding_windows(spark, sf_dir):
    return wave.sliding_summary(beats(spark, sf_dir).withColumn("idx", F.col("idx") - 1), 20, 10)


@query("linear_interpolation", f"""WITH {SAMPLES_SQL},
m AS (SELECT record, idx, CASE WHEN abs(x) <= 0.2 THEN x END AS x FROM samples),
k AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER p AS i0, last_value(x IGNORE NULLS) OVER p AS x0,
  first_value(CASE WHEN x IS NOT NULL THEN idx END IGNORE NULLS) OVER q AS i1, first_value(x IGNORE NULLS) OVER q AS x1 FROM m
  WINDOW p AS (PARTITION BY record ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY record ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT record, idx, round(coalesce(x, CASE WHEN i0 IS NULL THEN x1 WHEN i1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * (idx - i0) / (i1 - i0)::DOUBLE END), 6) AS x FROM k""")
def linear_interpolation(spark, sf_dir):
    return wave.interpolate(samples(spark, sf_dir).withColumn("x", F.when(F.abs("x") <= 0.2, F.col("x"))))


@query("rms_envelope", f"""WITH {SAMPLES_SQL}
SELECT record, idx, round(sqrt(sum(x * x) OVER (PARTITION BY record ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4), 6) AS rms FROM samples""")
def rms_envelope(spark, sf_dir):
    return wave.rolling_rms(samples(spark, sf_dir), 4).select("record", "idx", r6("rms").alias("rms"))


@query("dual_channel_ratio", """
WITH a AS (SELECT user_id AS record, event_type AS kind, quantile_cont(value, 0.95) - quantile_cont(value, 0.05) AS ac, median(value) AS dc FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
r AS (SELECT v.record, (v.ac / v.dc) / (c.ac / c.dc) AS r FROM a v JOIN a c ON v.record = c.record AND v.kind = 'view' AND c.kind = 'click' WHERE v.dc > 0 AND c.dc > 0 AND c.ac > 0)
SELECT record, round(r, 6) AS ratio, round(greatest(50, least(100, 110 - 25 * r)), 6) AS spo2 FROM r""")
def dual_channel_ratio(spark, sf_dir):
    return wave.dual_channel_ratio(beats(spark, sf_dir), "view", "click")


@query("modality_scores", f"""WITH {SAMPLES_SQL},
m AS (SELECT *, median(x) OVER (PARTITION BY record) AS med FROM samples), g AS (SELECT *, sign(x - med) * lag(sign(x - med)) OVER (PARTITION BY record ORDER BY idx) < 0 AS crossing FROM m),
f AS (SELECT record, round(stddev_pop(x), 6) AS sd, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(count(*) FILTER (WHERE crossing) / count(crossing)::DOUBLE, 6) AS rate, round(avg(x), 6) AS mean FROM g GROUP BY record),
s AS (SELECT record, unnest(['slow', 'fast', 'spiky', 'wide']) AS modality, unnest([1.0::DOUBLE + CASE WHEN rate < 0.45 THEN 2 ELSE 0 END + CASE WHEN abs(mean) > 0.01 THEN 0.5 ELSE 0 END,
  1.0::DOUBLE + CASE WHEN rate > 0.5 THEN 2 ELSE 0 END, 1.0::DOUBLE + CASE WHEN sd > iqr * 0.8 THEN 1.5 ELSE 0 END, 1.0::DOUBLE + CASE WHEN iqr > 0.17 THEN 1.5 ELSE 0 END]) AS score FROM f),
p AS (SELECT record, modality, score / sum(score) OVER (PARTITION BY record) AS p FROM s)
SELECT record, modality, round(p, 6) AS probability, row_number() OVER (PARTITION BY record ORDER BY round(p, 6) DESC, modality) AS rank FROM p""")
def modality_scores(spark, sf_dir):
    return wave.modality_scores(samples(spark, sf_dir))


@query("image_scale_risk", """
WITH w AS (SELECT p_partkey AS image, 200 + p_partkey % 1400 AS width, 1.0::DOUBLE + p_partkey % 60 AS duration, CASE p_partkey % 3 WHEN 0 THEN 40.0::DOUBLE WHEN 1 THEN 8.0::DOUBLE ELSE 2.0::DOUBLE END AS hz FROM part),
c AS (SELECT *, width / duration / hz AS ppc FROM w)
SELECT image, round(ppc, 6) AS pixels_per_cycle, CASE WHEN ppc >= 8 THEN 'low' WHEN ppc >= 3 THEN 'moderate' ELSE 'high' END AS risk,
  CASE WHEN ppc >= 8 THEN 'digitize' WHEN ppc >= 3 THEN 'digitize_with_caution' ELSE 'classify_image' END AS strategy FROM c""")
def image_scale_risk(spark, sf_dir):
    from ..sources.tables import table

    k = F.col("p_partkey")
    images = table(spark, sf_dir, "part").select(
        k.alias("image"), (200 + k % 1400).alias("width"), (1.0 + k % 60).alias("duration"), F.when(k % 3 == 0, 40.0).when(k % 3 == 1, 8.0).otherwise(2.0).alias("hz")
    )
    return wave.resolution_risk(images)
