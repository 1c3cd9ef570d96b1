"""Saturation queries; high event values read as low saturation."""

from ..operators import events, oximetry as op
from ..sources.tables import OXIMETRY_SQL, oximetry
from . import query
from pyspark.sql import functions as F

SUMMARY = f"""WITH {OXIMETRY_SQL},
s AS (SELECT record, count(*) AS n, round(avg(spo2), 6) AS mean_spo2, round(median(spo2), 6) AS median_spo2, round(min(spo2), 6) AS nadir,
  round(avg((spo2 < 90)::INT), 6) AS t90, round(avg((spo2 < 88)::INT), 6) AS t88, round(avg((spo2 < 85)::INT), 6) AS t85 FROM oximetry GROUP BY record)"""
BASELINE = f"""WITH {OXIMETRY_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY record) AS n FROM oximetry),
base AS (SELECT record, idx, spo2, round(CASE WHEN n <= 20 THEN max(least(spo2, 100)) OVER (PARTITION BY record ORDER BY idx)
  ELSE quantile_cont(spo2, 0.9) OVER (PARTITION BY record ORDER BY idx ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) END, 6) AS baseline FROM c)"""


def _odi(drop: float, least: int) -> str:
    return f"""(SELECT t.record, coalesce(e.events, 0) AS events, round(coalesce(e.events, 0) / (t.n / 3600.0::DOUBLE), 6) AS odi FROM (SELECT record, count(*) AS n FROM base GROUP BY record) t
  LEFT JOIN (SELECT record, count(*) AS events FROM (SELECT record, idx - row_number() OVER (PARTITION BY record ORDER BY idx) AS island FROM base WHERE spo2 < baseline - {drop})
    GROUP BY record, island HAVING count(*) >= {least}) x ON false LEFT JOIN (SELECT record, count(*) AS events FROM (SELECT record, island FROM
    (SELECT record, idx - row_number() OVER (PARTITION BY record ORDER BY idx) AS island FROM base WHERE spo2 < baseline - {drop}) GROUP BY record, island HAVING count(*) >= {least}) GROUP BY record) e USING (record))""".replace(
        f"""
  LEFT JOIN (SELECT record, count(*) AS events FROM (SELECT record, idx - row_number() OVER (PARTITION BY record ORDER BY idx) AS island FROM base WHERE spo2 < baseline - {drop})
    GROUP BY record, island HAVING count(*) >= {least}) x ON false LEFT JOIN""",
        " LEFT JOIN",
    )


@query("spo2_summary", SUMMARY + " SELECT * FROM s")
def spo2_summary(spark, sf_dir):
    return op.summary(oximetry(spark, sf_dir))


@query("hypoxemia_burden", SUMMARY + """,
d AS (SELECT record, idx, greatest(0, 90 - spo2) AS d FROM oximetry),
l AS (SELECT record, d, lead(d) OVER (PARTITION BY record ORDER BY idx) AS nx FROM d),
a AS (SELECT record, round(coalesce(sum((d + nx) / 2), 0) / 60 / (count(*) / 3600.0::DOUBLE), 6) AS area_per_hour FROM l GROUP BY record)
SELECT record, nadir, t90, t88, area_per_hour, CASE WHEN t88 > 0.05 OR nadir < 85 OR area_per_hour > 5 THEN 'high' WHEN t90 > 0.05 OR area_per_hour > 1 THEN 'moderate' ELSE 'low' END AS burden FROM s JOIN a USING (record)""")
def hypoxemia_burden(spark, sf_dir):
    return op.hypoxemia_burden(oximetry(spark, sf_dir))


@query("rolling_baseline", BASELINE + " SELECT record, idx, spo2, baseline FROM base")
def rolling_baseline(spark, sf_dir):
    return op.rolling_baseline(oximetry(spark, sf_dir), 20)


@query("odi_severity", BASELINE + f" SELECT record, events, odi, CASE WHEN odi >= 30 THEN 'severe' WHEN odi >= 15 THEN 'moderate' WHEN odi >= 5 THEN 'mild' ELSE 'normal' END AS severity FROM {_odi(3, 2)}")
def odi_severity(spark, sf_dir):
    return op.odi_severity(oximetry(spark, sf_dir), 3.0, 20, 2)


@query("apnea_risk", BASELINE + f""", t AS (SELECT record, round(avg((spo2 < 90)::INT), 6) AS t90 FROM oximetry GROUP BY record),
r AS (SELECT a.record, round(least(a.odi / 30, 1) * 0.55::DOUBLE + least(b.odi / 20, 1) * 0.25::DOUBLE + least(t90 / 0.15::DOUBLE, 1) * 0.20::DOUBLE, 6) AS score FROM {_odi(3, 1)} a JOIN {_odi(4, 1)} b USING (record) JOIN t USING (record))
SELECT record, score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'moderate' ELSE 'low' END AS risk FROM r""")
def apnea_risk(spark, sf_dir):
    return op.apnea_risk(oximetry(spark, sf_dir), 20)


#: The scan of ``desaturations`` reading by reading: state (start, last), and the closed events so far.
DESATURATIONS = BASELINE.replace("WITH ", "WITH RECURSIVE ", 1) + """, a AS (SELECT record, list(spo2 ORDER BY idx) AS x, list(baseline ORDER BY idx) AS b, count(*) AS n FROM base GROUP BY record),
r AS (SELECT record, 0::BIGINT AS i, 0::BIGINT AS st, 0::BIGINT AS la, []::STRUCT(s BIGINT, l BIGINT)[] AS ev FROM a UNION ALL
  SELECT record, i + 1, CASE WHEN low AND st = 0 THEN i + 1 WHEN shut THEN 0 ELSE st END, CASE WHEN low THEN i + 1 ELSE la END, CASE WHEN shut THEN list_append(ev, {'s': st, 'l': la}) ELSE ev END
  FROM (SELECT r.*, n, x[i + 1] < b[i + 1] - 3 AS low, NOT (x[i + 1] < b[i + 1] - 3) AND st > 0 AND (x[i + 1] >= b[st] - 1 OR i + 1 - la > 3) AS shut FROM r JOIN a USING (record) WHERE i < n)),
fin AS (SELECT record, CASE WHEN st > 0 THEN list_append(ev, {'s': st, 'l': la}) ELSE ev END AS ev FROM r JOIN a USING (record) WHERE i = n),
e AS (SELECT record, unnest(ev) AS e FROM fin), p AS (SELECT e.record, e.s AS s, e.l AS l, b[e.s] AS b0, x[e.s:e.l] AS part FROM e JOIN a USING (record)),
u AS (SELECT *, list_transform(part, lambda z: greatest(0, b0 - z)) AS under FROM p)
SELECT record, s - 1 AS start, l AS "end", (l - s + 1)::DOUBLE AS duration_s, round(b0 - list_min(part), 6) AS depth, list_min(part) AS nadir, round(list_sum(under) - (under[1] + under[len(under)]) / 2, 6) AS area FROM u"""


@query("desaturation_events", DESATURATIONS)
def desaturation_events(spark, sf_dir):
    return op.desaturations(oximetry(spark, sf_dir), 3.0, 20, 1)


@query("run_length_events", f"""WITH {OXIMETRY_SQL},
f AS (SELECT record, idx, idx - row_number() OVER (PARTITION BY record ORDER BY idx) AS island FROM oximetry WHERE spo2 < 95)
SELECT record, min(idx) AS start, max(idx) + 1 AS "end", count(*) AS length FROM f GROUP BY record, island HAVING count(*) >= 3""")
def run_length_events(spark, sf_dir):
    return events.runs(oximetry(spark, sf_dir), F.col("spo2") < 95, 3)
