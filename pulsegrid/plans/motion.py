"""Motion and pressure queries."""

from ..operators import motion as op
from ..operators import pressure
from ..sources.tables import BEATS_SQL, SAMPLES_SQL, beats, samples, table
from . import query
from pyspark.sql import functions as F

ACT = f"""WITH {SAMPLES_SQL}, d AS (SELECT record, idx, abs(x - median(x) OVER (PARTITION BY record)) AS e FROM samples),
ep AS (SELECT record, idx // 8 AS epoch, avg(e) AS m FROM d GROUP BY record, idx // 8),
act AS (SELECT record, count(*) AS epochs, round(avg(m), 6) AS mean_enmo, round(avg((m < 0.03)::INT), 6) AS rest, round(avg((m >= 0.03 AND m < 0.05)::INT), 6) AS sedentary,
  round(avg((m >= 0.05 AND m < 0.12)::INT), 6) AS light, round(avg((m >= 0.12)::INT), 6) AS mvpa FROM ep GROUP BY record)"""
PRESSURE = f"""WITH {BEATS_SQL}, p AS (SELECT record, idx, t, 80 + least(x, 90) AS sbp, 45 + 50 * (x - floor(x)) AS dbp FROM beats)"""


def pressures(spark, sf_dir):
    x = F.col("x")
    return beats(spark, sf_dir).select("record", "idx", "t", (80 + F.least(x, F.lit(90.0))).alias("sbp"), (45 + 50 * (x - F.floor(x))).alias("dbp"))


@query("rms_bouts", f"""WITH {SAMPLES_SQL}, c AS (SELECT record, idx, x - median(x) OVER (PARTITION BY record) AS x FROM samples),
r AS (SELECT record, idx, sqrt(sum(x * x) OVER (PARTITION BY record ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4) AS rms FROM c),
t AS (SELECT *, greatest(median(rms) OVER (PARTITION BY record) + 2 * stddev_pop(rms) OVER (PARTITION BY record), 0.06) AS thr FROM r),
i AS (SELECT record, idx, idx - row_number() OVER (PARTITION BY record ORDER BY idx) AS island FROM t WHERE rms > thr)
SELECT record, min(idx) AS start, max(idx) + 1 AS "end", count(*) AS length FROM i GROUP BY record, island HAVING count(*) >= 2""")
def rms_bouts(spark, sf_dir):
    return op.activity_bouts(samples(spark, sf_dir), 4, 2)


@query("epoch_actigraphy", ACT + " SELECT * FROM act")
def epoch_actigraphy(spark, sf_dir):
    return op.epoch_actigraphy(samples(spark, sf_dir), 8)


@query("sleep_wake_rule", ACT + " SELECT record, rest, mean_enmo, CASE WHEN rest >= 0.6 AND mean_enmo < 0.05 THEN 'sleep' WHEN mean_enmo < 0.1 THEN 'quiet_wake' ELSE 'active_wake' END AS state FROM act")
def sleep_wake_rule(spark, sf_dir):
    return op.sleep_wake(samples(spark, sf_dir), 8)


@query("axis_magnitude_corr", """WITH a AS (SELECT vec_id AS record, embedding[i]::DOUBLE AS x, embedding[i + 22]::DOUBLE AS y, embedding[i + 44]::DOUBLE AS z FROM (SELECT vec_id, embedding, unnest(generate_series(1, 22)) AS i FROM embeddings)),
m AS (SELECT *, sqrt(x * x + y * y + coalesce(z * z, 0)) AS m FROM a)
SELECT record, round(avg(m), 6) AS mean_magnitude, round(stddev_pop(m), 6) AS sd_magnitude, round(corr(x, y), 6) AS corr_xy, round(corr(x, z), 6) AS corr_xz, round(corr(y, z), 6) AS corr_yz FROM m GROUP BY record""")
def axis_magnitude_corr(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record"), F.col("embedding").cast("array<double>").alias("e"))
    third = F.ceil(F.size("e") / 3).cast("int")
    axis = lambda k: F.slice("e", k * third + 1, third)
    rows = e.select("record", F.explode(F.arrays_zip(axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z"))).alias("a")).select("record", "a.x", "a.y", "a.z")
    return op.axis_features(rows)


@query("abp_beat_burden", PRESSURE + """, m AS (SELECT *, sbp - dbp AS pp, dbp + (sbp - dbp) / 3 AS map FROM p),
a AS (SELECT record, count(*) AS beats, round(avg(map), 6) AS mean_map, round(avg((map < 65 OR sbp < 90)::INT), 6) AS hypo, round(avg((map < 55)::INT), 6) AS severe,
  round(avg((sbp >= 140 OR dbp >= 90)::INT), 6) AS hyper, round(avg((pp < 25)::INT), 6) AS narrow, round(avg((pp > 80)::INT), 6) AS wide FROM m GROUP BY record)
SELECT *, CASE WHEN severe >= 0.1 OR (hypo >= 0.3 AND narrow >= 0.2) THEN 'high_hypotension' WHEN hypo >= 0.2 THEN 'hypotension' WHEN hyper >= 0.2 THEN 'hypertension' ELSE 'low' END AS risk FROM a""")
def abp_beat_burden(spark, sf_dir):
    return pressure.beat_burden(pressures(spark, sf_dir))


@query("ahe_minute_rule", PRESSURE + """, e AS (SELECT record, floor(t / 2)::BIGINT AS m, avg(dbp + (sbp - dbp) / 3) AS map FROM p GROUP BY 1, 2),
d AS (SELECT s.record, s.m, map FROM (SELECT record, unnest(generate_series(min(m), max(m))) AS m FROM e GROUP BY record) s LEFT JOIN e USING (record, m)),
w AS (SELECT record, m, sum(CASE WHEN round(map, 6) < 85 THEN 1 ELSE 0 END) OVER q AS low, count(map) OVER q AS valid FROM d WINDOW q AS (PARTITION BY record ORDER BY m ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
i AS (SELECT record, (m - 4)::DOUBLE AS s, (m + 1)::DOUBLE AS e FROM w WHERE low >= 3 AND valid >= 2.5),
n AS (SELECT *, coalesce((s > max(e) OVER (PARTITION BY record ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1)::INT, 1) AS new FROM i),
g AS (SELECT *, sum(new) OVER (PARTITION BY record ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT record, min(s) AS start, max(e) AS "end", count(*) AS parts FROM g GROUP BY record, island""")
def ahe_minute_rule(spark, sf_dir):
    rows = pressures(spark, sf_dir).select("record", "t", (F.col("dbp") + (F.col("sbp") - F.col("dbp")) / 3).alias("map"))
    return pressure.hypotensive_episodes(rows, threshold=85.0, minute=2.0, window=5, fraction=0.6)
