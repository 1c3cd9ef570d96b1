"""Report, export and fusion queries."""

from ..operators import intervals, oximetry as oxi, quality, reports as op
from ..sources.tables import beats, oximetry, table
from . import SQL, query
from . import oximetry as _oximetry  # noqa: F401  their SQL is reused below
from . import rhythm as _rhythm  # noqa: F401
from . import signals as _signals  # noqa: F401
from pyspark.sql import functions as F


@query("trace_export", """WITH k AS (SELECT conv_id, max((role = 'system')::INT) AS s FROM conversations GROUP BY 1),
a AS (SELECT conv_id AS trace, turn, text, s FROM conversations JOIN k USING (conv_id) WHERE role = 'assistant')
SELECT trace, turn, task, length(text) AS chars FROM (SELECT *, 'planning' AS task FROM a UNION ALL SELECT *, 'tool_use' FROM a WHERE s = 1 UNION ALL SELECT *, 'report' FROM a WHERE length(text) > 600)""")
def trace_export(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return op.training_rows(c.select(F.col("conv_id").alias("trace"), "turn", "role", "text"))


@query("trace_task_counts", """WITH k AS (SELECT conv_id, max((role = 'system')::INT) AS s FROM conversations GROUP BY 1), a AS (SELECT text, s FROM conversations JOIN k USING (conv_id) WHERE role = 'assistant')
SELECT task, count(*) AS n FROM (SELECT 'planning' AS task FROM a UNION ALL SELECT 'tool_use' FROM a WHERE s = 1 UNION ALL SELECT 'report' FROM a WHERE length(text) > 600) GROUP BY task""")
def trace_task_counts(spark, sf_dir):
    return trace_export(spark, sf_dir).groupBy("task").agg(F.count("*").alias("n"))


@query("json_result_extract", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def json_result_extract(spark, sf_dir):
    found = op.json_object(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(found, "k int")["k"].alias("k"))


@query("report_template", f"""SELECT record, printf('Record %d: %d intervals, mean rate %.1f bpm, RMSSD %.1f ms, %s risk.', record, n, mean_hr_bpm, rmssd_ms, risk) AS report FROM ({SQL['entry_hrv_flags']})""")
def report_template(spark, sf_dir):
    return op.sentences(intervals.hrv_time(beats(spark, sf_dir)))


@query("weighted_fusion", f"""WITH a AS ({SQL['afib_heuristic']}), o AS ({SQL['apnea_risk']}), s AS ({SQL['stress_score']}),
f AS (SELECT u.record, a.probability AS p, o.score AS q, s.score / 2.25 AS r FROM (SELECT DISTINCT user_id AS record FROM events) u LEFT JOIN a USING (record) LEFT JOIN o USING (record) LEFT JOIN s USING (record)),
w AS (SELECT record, coalesce(p * 0.35::DOUBLE, 0) + coalesce(q * 0.45::DOUBLE, 0) + coalesce(r * 0.2::DOUBLE, 0) AS t, CASE WHEN p IS NULL THEN 0 ELSE 0.35::DOUBLE END + CASE WHEN q IS NULL THEN 0 ELSE 0.45::DOUBLE END + CASE WHEN r IS NULL THEN 0 ELSE 0.2::DOUBLE END AS w FROM f),
z AS (SELECT record, w, round(coalesce(t / nullif(w, 0), 0), 6) AS score FROM w)
SELECT record, score, CASE WHEN w = 0 THEN 'unknown' WHEN score >= 0.65 THEN 'high' WHEN score >= 0.45 THEN 'moderate' WHEN score >= 0.25 THEN 'mild' ELSE 'low' END AS level FROM z""")
def weighted_fusion(spark, sf_dir):
    b = beats(spark, sf_dir)
    parts = b.select("record").distinct()
    parts = parts.join(intervals.afib_heuristic(b).select("record", F.col("probability").alias("ecg")), "record", "left")
    parts = parts.join(oxi.apnea_risk(oximetry(spark, sf_dir), 20).select("record", F.col("score").alias("spo2")), "record", "left")
    parts = parts.join(intervals.stress_score(b).select("record", (F.col("score") / 2.25).alias("stress")), "record", "left")
    return op.weighted_fusion(parts, {"ecg": 0.35, "spo2": 0.45, "stress": 0.2})


@query("hr_session_fusion", f"""WITH a AS ({SQL['pulse_irregularity']}), o AS ({SQL['hypoxemia_burden']}), q AS ({SQL['artifact_flags']}),
f AS (SELECT u.record, coalesce(a.risk = 'elevated', false) AS x, coalesce(o.burden <> 'low', false) AS y, coalesce(q.level = 'high', false) AS z FROM (SELECT DISTINCT user_id AS record FROM events) u LEFT JOIN a USING (record) LEFT JOIN o USING (record) LEFT JOIN q USING (record))
SELECT record, concat_ws(',', CASE WHEN x THEN 'irregular_pulse' END, CASE WHEN y THEN 'hypoxemia' END, CASE WHEN z THEN 'artifacts' END) AS flags,
  CASE WHEN x::INT + y::INT + z::INT >= 2 THEN 'elevated' WHEN x OR y OR z THEN 'possible' ELSE 'low' END AS risk FROM f""")
def hr_session_fusion(spark, sf_dir):
    b = beats(spark, sf_dir)
    return op.session_fusion(
        b.select("record").distinct(),
        pulse=(intervals.pulse_irregularity(b), F.col("risk") == "elevated", "irregular_pulse"),
        oxygen=(oxi.hypoxemia_burden(oximetry(spark, sf_dir)), F.col("burden") != "low", "hypoxemia"),
        artifacts=(quality.artifact_flags(b), F.col("level") == "high", "artifacts"),
    )
