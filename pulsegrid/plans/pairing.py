"""Intervals, as-of pairs, range joins and window labels."""

from ..functions.columns import r6
from ..operators import events as op
from ..sources.tables import BEATS_SQL, beats
from . import query
from pyspark.sql import functions as F

VC = f"""WITH {BEATS_SQL}, v AS (SELECT record, t FROM beats WHERE kind = 'view'), c AS (SELECT record, t FROM beats WHERE kind = 'click')"""
MERGE = """n{k} AS (SELECT *, coalesce((s > max(e) OVER (PARTITION BY record ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap})::INT, 1) AS new FROM {src}),
g{k} AS (SELECT *, sum(new) OVER (PARTITION BY record ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n{k}),
m{k} AS (SELECT record, min(s) AS s, max(e) AS e, count(*) AS parts FROM g{k} GROUP BY record, island)"""


def _kind(spark, sf_dir, kind):
    return beats(spark, sf_dir).where(F.col("kind") == kind)


def _spans(rows, length):
    return rows.select("record", F.col("t").alias("start"), (F.col("t") + length).alias("end"))


@query("merge_intervals", f"""WITH {BEATS_SQL}, i AS (SELECT record, t AS s, t + 1.5 AS e FROM beats WHERE kind IN ('error', 'view')), {MERGE.format(k='', gap=0.5, src='i')}
SELECT record, round(s, 6) AS start, round(e, 6) AS "end", parts FROM m""")
def merge_intervals(spark, sf_dir):
    rows = beats(spark, sf_dir).where(F.col("kind").isin("error", "view"))
    m = op.merge_intervals(_spans(rows, 1.5), 0.5)
    return m.select("record", r6("start").alias("start"), r6("end").alias("end"), "parts")


@query("event_burden", f"""WITH {BEATS_SQL}, i AS (SELECT record, t AS s, t + 1.0 AS e FROM beats WHERE kind = 'error' UNION ALL SELECT record, t, t + 0.5 FROM beats WHERE kind = 'click'), {MERGE.format(k='', gap=0.25, src='i')},
sp AS (SELECT record, max(t) - min(t) AS seconds FROM beats GROUP BY record), a AS (SELECT record, count(*) AS events, sum(e - s) AS covered FROM m GROUP BY record),
b AS (SELECT record, coalesce(events, 0) AS events, round(coalesce(coalesce(events, 0) * 3600 / nullif(seconds, 0), 0), 6) AS per_hour, round(coalesce(coalesce(covered, 0) / nullif(seconds, 0), 0), 6) AS burden FROM sp LEFT JOIN a USING (record))
SELECT record, events, per_hour AS events_per_hour, burden, CASE WHEN per_hour >= 300 THEN 'severe' WHEN per_hour >= 150 THEN 'moderate' WHEN per_hour >= 50 THEN 'mild' ELSE 'none' END AS severity FROM b""")
def event_burden(spark, sf_dir):
    b = beats(spark, sf_dir)
    spans = b.groupBy("record").agg((F.max("t") - F.min("t")).alias("seconds"))
    return op.event_burden(_spans(b.where("kind = 'error'"), 1.0), _spans(b.where("kind = 'click'"), 0.5), spans, 0.25)


@query("breath_pairing", VC + """, a AS (SELECT record, t, lead(t) OVER (PARTITION BY record ORDER BY t) AS nx FROM v)
SELECT record, round(t, 6) AS anchor, round((SELECT min(c.t) FROM c WHERE c.record = a.record AND c.t > a.t AND (a.nx IS NULL OR c.t < a.nx)), 6) AS target FROM a""")
def breath_pairing(spark, sf_dir):
    p = op.before_next_anchor(_kind(spark, sf_dir, "view"), _kind(spark, sf_dir, "click"))
    return p.select("record", r6("anchor").alias("anchor"), r6("target").alias("target"))


PAT = """, d AS (SELECT record, target - ref AS d FROM p WHERE target - ref BETWEEN 0.08 AND 3.0)
SELECT record, count(*) AS n, round(1000 * median(d), 6) AS median_ms, round(1000 * (quantile_cont(d, 0.75) - quantile_cont(d, 0.25)), 6) AS iqr_ms FROM d GROUP BY record HAVING count(*) >= 3"""


@query("pat_next_peak", VC + ", p AS (SELECT v.record, v.t AS ref, c.t AS target FROM v ASOF JOIN c ON v.record = c.record AND v.t < c.t)" + PAT)
def pat_next_peak(spark, sf_dir):
    return op.arrival_times(op.next_after(_kind(spark, sf_dir, "view"), _kind(spark, sf_dir, "click")), 0.08, 3.0)


@query("pat_min_delay", VC + ", s AS (SELECT *, t + 0.08::DOUBLE AS u FROM v), p AS (SELECT s.record, s.t AS ref, c.t AS target FROM s ASOF JOIN c ON s.record = c.record AND s.u < c.t)" + PAT)
def pat_min_delay(spark, sf_dir):
    return op.arrival_times(op.next_after(_kind(spark, sf_dir, "view"), _kind(spark, sf_dir, "click"), 0.08), 0.08, 3.0)


@query("bounded_backward_pairs", VC + """, s AS (SELECT *, t + -0.25::DOUBLE AS u FROM c), p AS (SELECT s.record, s.t AS target, v.t AS ref FROM s ASOF LEFT JOIN v ON s.record = v.record AND s.u >= v.t)
SELECT record, round(target, 6) AS target, round(CASE WHEN ref >= target - 2.0 THEN ref END, 6) AS ref FROM p""")
def bounded_backward_pairs(spark, sf_dir):
    p = op.previous_within(_kind(spark, sf_dir, "view"), _kind(spark, sf_dir, "click"), 0.25, 2.0)
    return p.select("record", r6("target").alias("target"), r6("ref").alias("ref"))


@query("offset_window_extreme", f"""WITH {BEATS_SQL}, n AS (SELECT r.record, r.t AS ref, b.t, b.x, row_number() OVER (PARTITION BY r.record, r.t ORDER BY abs(b.x) DESC, b.t) AS k
  FROM beats r JOIN beats b ON r.record = b.record AND r.kind = 'view' AND b.t >= r.t + 0.1::DOUBLE AND b.t < r.t + 2.0::DOUBLE)
SELECT record, round(ref, 6) AS ref, round(t, 6) AS t, round(x, 6) AS x FROM n WHERE k = 1""")
def offset_window_extreme(spark, sf_dir):
    return op.offset_extreme(_kind(spark, sf_dir, "view"), beats(spark, sf_dir), 0.1, 2.0)


@query("systole_diastole", VC + """, a AS (SELECT record, t, lead(t) OVER (PARTITION BY record ORDER BY t) AS nx FROM v),
p AS (SELECT record, t, nx, (SELECT min(c.t) FROM c WHERE c.record = a.record AND c.t > a.t AND (a.nx IS NULL OR c.t < a.nx)) AS tg FROM a),
q AS (SELECT record, tg - t AS sys, nx - tg AS dia FROM p WHERE tg IS NOT NULL),
r AS (SELECT record, count(*) AS pairs, median(sys) AS s, median(dia) AS d, coalesce(stddev_pop(sys) / nullif(avg(sys), 0), 0) AS sc, coalesce(stddev_pop(dia) / nullif(avg(dia), 0), 0) AS dc FROM q GROUP BY record)
SELECT record, pairs, round(s, 6) AS systole_s, round(d, 6) AS diastole_s, round(sc, 6) AS systole_cv, round(dc, 6) AS diastole_cv, round(coalesce(s / nullif(d, 0), 0), 6) AS sd_ratio FROM r""")
def systole_diastole(spark, sf_dir):
    return op.systole_diastole(_kind(spark, sf_dir, "view"), _kind(spark, sf_dir, "click"))


@query("longitudinal_monitor", f"""WITH {BEATS_SQL}, a AS (SELECT record, count(*) AS n, arg_min(x, idx) AS f, arg_max(x, idx) AS l FROM beats GROUP BY record),
c AS (SELECT *, coalesce((l - f) / nullif(abs(f), 0), 0) AS change FROM a)
SELECT record, n, round(f, 6) AS first_value, round(l, 6) AS last_value, round(change, 6) AS change, CASE WHEN change > 0.2 THEN 'rise' WHEN change < -0.2 THEN 'fall' ELSE '' END AS flags FROM c""")
def longitudinal_monitor(spark, sf_dir):
    return op.longitudinal_change(beats(spark, sf_dir))


def _windows(spark, sf_dir):
    b = beats(spark, sf_dir).groupBy("record", F.floor(F.col("t") / 10).alias("w")).agg(F.count("*").alias("n"))
    return b.select("record", "w", (F.col("w") * 10).cast("double").alias("start"), (F.col("w") * 10 + 10).cast("double").alias("end"))


@query("window_overlap_labels", f"""WITH {BEATS_SQL}, w AS (SELECT DISTINCT record, floor(t / 10)::BIGINT AS w FROM beats), a AS (SELECT record, t AS s, t + 2.5 AS e FROM beats WHERE kind = 'error'),
h AS (SELECT w.record, w.w, count(*) AS n, sum(least(e, w.w * 10 + 10) - greatest(s, w.w * 10)) AS o FROM w JOIN a ON w.record = a.record AND a.s < w.w * 10 + 10 AND a.e > w.w * 10 GROUP BY 1, 2)
SELECT record, w, coalesce(n, 0) AS overlaps, round(coalesce(o, 0), 6) AS overlap_s, CASE WHEN n > 0 THEN 'event' ELSE 'normal' END AS label FROM w LEFT JOIN h USING (record, w)""")
def window_overlap_labels(spark, sf_dir):
    return op.overlap_labels(_windows(spark, sf_dir), _spans(_kind(spark, sf_dir, "error"), 2.5), 10.0)


@query("window_majority_label", f"""WITH {BEATS_SQL}, e AS (SELECT record, floor(t / 10)::BIGINT AS w, kind, count(*) AS n FROM beats GROUP BY 1, 2, 3)
SELECT record, w, kind AS label, round(n / (sum(n) OVER (PARTITION BY record, w))::DOUBLE, 6) AS share FROM e QUALIFY row_number() OVER (PARTITION BY record, w ORDER BY n DESC, kind) = 1""")
def window_majority_label(spark, sf_dir):
    return op.majority_labels(beats(spark, sf_dir), 10.0)


#: Each click in order takes the nearest free view within half a second, the first of equals.
MATCHING = f"""WITH RECURSIVE {BEATS_SQL}, m AS (SELECT record, coalesce(list(t ORDER BY t) FILTER (WHERE kind = 'click'), []) AS ds, coalesce(list(t ORDER BY t) FILTER (WHERE kind = 'view'), []) AS ts FROM beats WHERE kind IN ('click', 'view') GROUP BY record),
r AS (SELECT record, 0::BIGINT AS i, []::BIGINT[] AS used FROM m UNION ALL
  SELECT record, i + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.j) END FROM (
    SELECT r.record, i, used, list_min(list_transform(list_filter(range(1, len(ts) + 1), lambda j: abs(ts[j] - ds[i + 1]) <= 0.5 AND NOT list_contains(used, j)), lambda j: {{'d': abs(ts[j] - ds[i + 1]), 'j': j}})) AS best FROM r JOIN m USING (record) WHERE i < len(ds))),
f AS (SELECT record, len(used) AS tp, len(ds) AS d, len(ts) AS t FROM r JOIN m USING (record) WHERE i = len(ds)), g AS (SELECT *, CASE WHEN d > 0 THEN tp / d::DOUBLE ELSE 0 END AS p, CASE WHEN t > 0 THEN tp / t::DOUBLE ELSE 0 END AS q FROM f)
SELECT record, tp, d - tp AS fp, t - tp AS fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM g"""


@query("tolerance_matching", MATCHING)
def tolerance_matching(spark, sf_dir):
    return op.match_events(_kind(spark, sf_dir, "click"), _kind(spark, sf_dir, "view"), 0.5)


@query("session_window_stream", """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n FROM g GROUP BY user_id, k""")
def session_window_stream(spark, sf_dir):
    from ..streaming.windows import event_rows, sessions

    return sessions(event_rows(spark, sf_dir))


def _stretches(spark, sf_dir, kind, late):
    """Events of a kind as intervals whose length follows from their value."""
    t = F.col("t") + late
    return beats(spark, sf_dir).where(F.col("kind") == kind).select("record", t.alias("start"), (t + 0.2 + F.col("x") / 100).alias("end"))


def _interval_matching(rule: str, tolerance: float) -> str:
    """The scan of ``match_intervals`` step by step: the partners used so far, and their overlap over union."""
    a, h = ("ts", "ds") if rule == "after" else ("ds", "ts")
    shared = f"least({a}[i + 1].e, {h}[j].e) - greatest({a}[i + 1].s, {h}[j].s)"
    fits, score = {
        "edges": (f"abs({a}[i + 1].s - {h}[j].s) <= {tolerance} AND abs({a}[i + 1].e - {h}[j].e) <= {tolerance}", f"abs({a}[i + 1].s - {h}[j].s) + abs({a}[i + 1].e - {h}[j].e)"),
        "overlap": (f"{shared} > 0 AND {shared} >= {tolerance}", f"-({shared})"),
        "after": (f"{h}[j].s - {a}[i + 1].s BETWEEN 0 AND {tolerance}", f"{h}[j].s - {a}[i + 1].s"),
    }[rule]
    union = f"greatest({a}[i + 1].e, {h}[best.j].e) - least({a}[i + 1].s, {h}[best.j].s)"
    return f"""WITH RECURSIVE {BEATS_SQL}, sp AS (SELECT record, kind, t + late AS s, t + late + 0.2::DOUBLE + x / 100 AS e FROM (SELECT *, CASE kind WHEN 'view' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS late FROM beats WHERE kind IN ('click', 'view'))),
m AS (SELECT record, coalesce(list({{'s': s, 'e': e}} ORDER BY s, e) FILTER (WHERE kind = 'click'), []) AS ds, coalesce(list({{'s': s, 'e': e}} ORDER BY s, e) FILTER (WHERE kind = 'view'), []) AS ts FROM sp GROUP BY record),
r AS (SELECT record, 0::BIGINT AS i, []::BIGINT[] AS used, 0.0::DOUBLE AS iou FROM m UNION ALL
  SELECT record, i + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.j) END, iou + CASE WHEN best IS NULL THEN 0 ELSE greatest(0, {shared.replace("[j]", "[best.j]")}) / greatest({union}, 1e-12::DOUBLE) END FROM (
    SELECT r.record, i, used, iou, ds, ts, list_min(list_transform(list_filter(range(1, len({h}) + 1), lambda j: {fits} AND NOT list_contains(used, j)), lambda j: {{'d': {score}, 'j': j}})) AS best FROM r JOIN m USING (record) WHERE i < len({a}))),
f AS (SELECT record, len(used) AS tp, len(ds) AS d, len(ts) AS t, iou FROM r JOIN m USING (record) WHERE i = len({a})), g AS (SELECT *, CASE WHEN d > 0 THEN tp / d::DOUBLE ELSE 0 END AS p, CASE WHEN t > 0 THEN tp / t::DOUBLE ELSE 0 END AS q FROM f)
SELECT record, tp, d - tp AS fp, t - tp AS fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1, round(CASE WHEN tp > 0 THEN iou / tp ELSE 0 END, 6) AS mean_iou FROM g"""


@query("edge_matching", _interval_matching("edges", 1.0))
def edge_matching(spark, sf_dir):
    return op.match_intervals(_stretches(spark, sf_dir, "click", 0.0), _stretches(spark, sf_dir, "view", 0.1), "edges", 1.0)


@query("overlap_matching", _interval_matching("overlap", 0.1))
def overlap_matching(spark, sf_dir):
    return op.match_intervals(_stretches(spark, sf_dir, "click", 0.0), _stretches(spark, sf_dir, "view", 0.1), "overlap", 0.1)


@query("directional_matching", _interval_matching("after", 1.0))
def directional_matching(spark, sf_dir):
    return op.match_intervals(_stretches(spark, sf_dir, "click", 0.0), _stretches(spark, sf_dir, "view", 0.1), "after", 1.0)
