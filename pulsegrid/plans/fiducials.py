"""Fiducial point queries: vectors as signals of 16 samples a second."""

from pyspark.sql import functions as F

from ..operators import fiducials as op
from ..operators import intervals
from ..sources.tables import BEATS_SQL, SAMPLES_SQL, beats, samples
from . import query

RATE = 16.0

_TOPS = SAMPLES_SQL + """, w AS (SELECT *, max(x) OVER (PARTITION BY record ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS bf,
  max(x) OVER (PARTITION BY record ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS af, count(*) OVER (PARTITION BY record) AS n FROM samples),
tops AS (SELECT record, row_number() OVER (PARTITION BY record ORDER BY idx) - 1 AS beat, idx AS pk, n FROM w WHERE x > bf AND x >= af AND x > 0)"""


def _bounds(left: int, right: int) -> str:
    return f""", b AS (SELECT *, coalesce(lag(pk) OVER r, greatest(pk - {left}, 0)) AS prev, coalesce(lead(pk) OVER r, least(pk + {right}, n - 1)) AS nxt,
  count(*) OVER (PARTITION BY record) AS pulses FROM tops WINDOW r AS (PARTITION BY record ORDER BY pk))"""


def _extreme(name: str, of: str, start: str, end: str, largest: bool, turn: bool = False, x: str = "x") -> str:
    """A table ``of``_``name``: ``of`` with the first least or largest sample in [start, end)."""
    v = f"-{x}" if largest else x
    turns = "coalesce(min(idx) FILTER (WHERE v < lv AND v < rv), min(struct_pack(v := v, i := idx)).i)" if turn else "min(struct_pack(v := v, i := idx)).i"
    return f""", {name}_v AS (SELECT q.record, q.beat, idx, {v} AS v, lag({v}) OVER k AS lv, lead({v}) OVER k AS rv FROM {of} q JOIN samples s ON s.record = q.record AND idx >= {start} AND idx < {end}
  WINDOW k AS (PARTITION BY q.record, q.beat ORDER BY idx)),
{name}_m AS (SELECT record, beat, {turns} AS {name} FROM {name}_v GROUP BY record, beat), {of}_{name} AS (SELECT q.*, {name} FROM {of} q LEFT JOIN {name}_m m ON q.record = m.record AND q.beat = m.beat)"""


def _tops(spark, sf_dir):
    rows = samples(spark, sf_dir)
    return rows, op.tops(rows, 3)


@query("ppg_fiducials", f"""WITH {_TOPS}{_bounds(13, 13)}, p AS (SELECT * FROM b WHERE pulses >= 3){_extreme("onset", "p", "prev", "pk + 1", False)},
post AS (SELECT q.record, q.beat, idx, x, lead(x) OVER k - x AS f, x - lag(x) OVER k AS g FROM p q JOIN samples s ON s.record = q.record AND idx BETWEEN pk AND nxt WINDOW k AS (PARTITION BY q.record, q.beat ORDER BY idx)),
sl AS (SELECT *, CASE WHEN g IS NULL THEN f WHEN f IS NULL THEN g ELSE (f + g) / 2 END AS slope FROM post), fa AS (SELECT *, lag(slope) OVER (PARTITION BY record, beat ORDER BY idx) < 0 AS falls FROM sl),
nm AS (SELECT record, beat, coalesce(min(idx) FILTER (WHERE falls AND slope >= 0), min(struct_pack(v := x, i := idx)).i) AS notch FROM fa GROUP BY record, beat),
o AS (SELECT q.*, notch FROM p_onset q LEFT JOIN nm USING (record, beat)){_extreme("diastolic", "o", "notch + 1", "least(nxt, notch + 7)", True, turn=True)}
SELECT record, beat, onset, pk AS systolic, notch, diastolic FROM o_diastolic""")
def ppg_fiducials(spark, sf_dir):
    rows, beat = _tops(spark, sf_dir)
    return op.pulse_fiducials(rows, beat, RATE)


_MORPHOLOGY = f"""WITH {_TOPS}{_bounds(14, 19)}{_extreme("l", "b", "prev", "pk + 1", False)}{_extreme("r", "b_l", "pk", "nxt + 1", False)},
v AS (SELECT q.record, beat, pk, l, r, least(a.x, c.x) AS base, p.x - least(a.x, c.x) AS amplitude FROM b_l_r q JOIN samples a ON a.record = q.record AND a.idx = l JOIN samples c ON c.record = q.record AND c.idx = r JOIN samples p ON p.record = q.record AND p.idx = pk),
i AS (SELECT v.*, idx, greatest(x - base, 0.0::DOUBLE) AS o, x <= base + amplitude / 2 AS low FROM v JOIN samples s ON s.record = v.record AND idx BETWEEN l AND r WHERE amplitude > 0),
g AS (SELECT record, beat, pk, l, r, amplitude, max(idx) FILTER (WHERE low AND idx <= pk) AS up, min(idx) FILTER (WHERE low AND idx >= pk) AS down, sum(CASE WHEN idx = l OR idx = r THEN o / 2 ELSE o END) AS area FROM i GROUP BY ALL),
m AS (SELECT record, amplitude, (pk - l) / 16.0::DOUBLE AS rise, (r - pk) / 16.0::DOUBLE AS decay, (coalesce(down, r) - coalesce(up, l)) / 16.0::DOUBLE AS width, area / 16.0::DOUBLE AS area,
  amplitude / greatest((pk - l) / 16.0::DOUBLE, 1e-3::DOUBLE) AS slope FROM g),
sm AS (SELECT record, count(*) AS pulses, round(median(amplitude), 6) AS amplitude, round(median(rise), 6) AS rise, round(median(decay), 6) AS decay, round(median(width), 6) AS width, round(median(area), 6) AS area, round(median(slope), 6) AS slope,
  round(coalesce(stddev_pop(width) / nullif(median(width), 0), 0), 6) AS width_cv, round(coalesce(stddev_pop(area) / nullif(median(area), 0), 0), 6) AS area_cv, round(coalesce(stddev_pop(rise) / nullif(median(rise), 0), 0), 6) AS rise_cv FROM m GROUP BY record HAVING count(*) >= 3)"""


@query("ppg_morphology", f"{_MORPHOLOGY} SELECT * FROM sm")
def ppg_morphology(spark, sf_dir):
    rows, beat = _tops(spark, sf_dir)
    return op.morphology_summary(op.pulse_morphology(rows, beat, RATE))


@query("ppg_pressure_stiffness", f"""{_MORPHOLOGY},
f AS (SELECT *, rise < 0.12 AS fast, width < 0.22 AS narrow, slope > 2 * greatest(abs(amplitude), 1e-8) AS steep, coalesce(decay / nullif(rise, 0) > 4, false) AS long_decay FROM sm),
sc AS (SELECT *, round(CASE WHEN fast THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN narrow THEN 0.7::DOUBLE ELSE 0 END + CASE WHEN steep THEN 0.5::DOUBLE ELSE 0 END, 6) AS ps,
  round(CASE WHEN fast THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN narrow THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN long_decay THEN 0.5::DOUBLE ELSE 0 END, 6) AS ss FROM f)
SELECT record, ps AS pressure_score, CASE WHEN ps >= 1.2 THEN 'higher' ELSE 'no_evidence' END AS pressure_risk, ss AS stiffness_score, CASE WHEN ss >= 1.2 THEN 'elevated' ELSE 'not_elevated' END AS stiffness_risk,
  array_to_string(list_filter([CASE WHEN fast THEN 'fast_rise' END, CASE WHEN narrow THEN 'narrow_pulse' END, CASE WHEN steep THEN 'steep_upstroke' END, CASE WHEN long_decay THEN 'long_decay' END], lambda z: z IS NOT NULL), ',') AS flags FROM sc""")
def ppg_pressure_stiffness(spark, sf_dir):
    return op.pulse_proxies(ppg_morphology(spark, sf_dir))


_ABP = f"""WITH {_TOPS}{_bounds(13, 13)}{_extreme("onset", "b", "prev", "pk + 1", False)}{_extreme("notch", "b_onset", "pk + 1", "greatest(pk + 2, least(nxt, pk + 7))", False, turn=True)}
{_extreme("diastolic", "b_onset_notch", "notch + 1", "greatest(notch + 2, least(nxt, notch + 6))", True, turn=True)}{_extreme("finish", "b_onset_notch_diastolic", "coalesce(diastolic, notch, pk)", "nxt + 1", False)},
points AS (SELECT record, beat, onset, pk AS systolic, notch, diastolic, finish AS "end" FROM b_onset_notch_diastolic_finish)"""


@query("abp_fiducials", f"{_ABP} SELECT * FROM points")
def abp_fiducials(spark, sf_dir):
    rows, beat = _tops(spark, sf_dir)
    return op.pressure_fiducials(rows, beat, RATE)


@query("abp_missing_points", f"""{_ABP} SELECT record, count(*) AS beats, round(avg((onset IS NULL)::INT), 6) AS no_onset, round(avg((systolic IS NULL)::INT), 6) AS no_systolic, round(avg((notch IS NULL)::INT), 6) AS no_notch,
  round(avg((diastolic IS NULL)::INT), 6) AS no_diastolic, round(avg(("end" IS NULL)::INT), 6) AS no_end FROM points GROUP BY record""")
def abp_missing_points(spark, sf_dir):
    return op.missing_shares(abp_fiducials(spark, sf_dir))


_SCG = f"""WITH {_TOPS}{_bounds(13, 13)}, gap AS (SELECT *, pk - lag(pk) OVER (PARTITION BY record ORDER BY pk) AS gap FROM b), cy AS (SELECT record, median(gap) / 16.0::DOUBLE AS cycle FROM gap GROUP BY record),
z AS (SELECT b.*, cycle FROM b JOIN cy USING (record) WHERE cycle IS NOT NULL){_extreme("mc", "z", "pk - 3", "pk", True, x="abs(x)")}{_extreme("im", "z_mc", "pk - 1", "pk", True, x="abs(x)")}
{_extreme("ac", "z_mc_im", "pk + 3", "pk + round(least(0.45::DOUBLE, greatest(0.22::DOUBLE, 0.7::DOUBLE * cycle)) * 16)::BIGINT + 1", True, x="abs(x)")}
{_extreme("mo", "z_mc_im_ac", "ac + 1", "ac + round(least(0.3::DOUBLE, greatest(0.1::DOUBLE, (nxt - ac) / 16.0::DOUBLE - 0.03::DOUBLE)) * 16)::BIGINT + 1", True, x="abs(x)")},
points AS (SELECT record, beat, mc, im, pk AS ao, ac, mo FROM z_mc_im_ac_mo)"""


@query("scg_fiducials", f"{_SCG} SELECT * FROM points")
def scg_fiducials(spark, sf_dir):
    rows, beat = _tops(spark, sf_dir)
    return op.seismo_fiducials(rows, beat, RATE)


@query("scg_contractility", f"""{_SCG}, e AS (SELECT p.record, beat, ao, ac, avg(x * x) AS energy, max(abs(x)) FILTER (WHERE idx = ao) AS size FROM points p JOIN samples s ON s.record = p.record AND idx >= ao AND idx < ac WHERE ac IS NOT NULL GROUP BY ALL)
SELECT record, count(*) AS beats, round(median((ac - ao) * 1000.0::DOUBLE / 16), 6) AS ejection_ms, round(median(energy), 6) AS energy, round(median(size), 6) AS size, round(least(1.0, ln(1 + median(energy)) / 3), 6) AS score FROM e GROUP BY record""")
def scg_contractility(spark, sf_dir):
    return op.contractility(scg_fiducials(spark, sf_dir), samples(spark, sf_dir), RATE)


@query("pcg_extra_sounds", f"""WITH {_TOPS}, s1 AS (SELECT record, pk FROM tops WHERE beat % 2 = 0), s2 AS (SELECT record, pk FROM tops WHERE beat % 2 = 1),
c AS (SELECT record, pk, lead(pk) OVER (PARTITION BY record ORDER BY pk) AS nxt, row_number() OVER (PARTITION BY record ORDER BY pk) AS beat FROM s1),
d AS (SELECT c.record, beat, nxt, min(s2.pk) AS cl FROM c LEFT JOIN s2 ON s2.record = c.record AND s2.pk > c.pk AND s2.pk < nxt WHERE nxt IS NOT NULL GROUP BY ALL)
{_extreme("early", "d", "cl + 1", "least(nxt - 1, cl + 4)", True, x="abs(x)")}{_extreme("late", "d_early", "greatest(cl + 1, nxt - 4)", "nxt - 1", True, x="abs(x)")},
th AS (SELECT record, quantile_cont(abs(x), 0.72) AS loud FROM samples GROUP BY record),
n AS (SELECT q.record, count(*) AS cycles, count(*) FILTER (WHERE abs(a.x) >= loud) AS e, count(*) FILTER (WHERE abs(b.x) >= loud) AS l FROM d_early_late q JOIN th USING (record)
  LEFT JOIN samples a ON a.record = q.record AND a.idx = early LEFT JOIN samples b ON b.record = q.record AND b.idx = late GROUP BY q.record)
SELECT record, cycles, round(e / cycles::DOUBLE, 6) AS s3_score, round(l / cycles::DOUBLE, 6) AS s4_score,
  array_to_string(list_filter([CASE WHEN e / cycles::DOUBLE >= 0.35 THEN 'possible_s3' END, CASE WHEN l / cycles::DOUBLE >= 0.35 THEN 'possible_s4' END], lambda z: z IS NOT NULL), ',') AS flags FROM n""")
def pcg_extra_sounds(spark, sf_dir):
    rows, beat = _tops(spark, sf_dir)
    sound = lambda k: beat.where(F.col("beat") % 2 == k).select("record", "at")
    return op.extra_sounds(rows.withColumn("x", F.abs("x")), sound(0), sound(1), RATE)


@query("ecg_qrs_widths", f"""WITH {_TOPS}, q AS (SELECT * FROM tops WHERE pk >= 4 AND pk + 4 <= n),
i AS (SELECT q.record, beat, pk, idx, x, abs(x - lag(x) OVER (PARTITION BY q.record, beat ORDER BY idx)) AS step, idx < pk - 3 OR idx >= pk + 3 AS outside FROM q JOIN samples s ON s.record = q.record AND idx >= pk - 4 AND idx < pk + 4),
l AS (SELECT record, beat, median(x) FILTER (WHERE outside) AS level, max(x) AS top, min(x) AS low FROM i GROUP BY record, beat),
h AS (SELECT i.*, top, low, abs(x - level) >= 0.35::DOUBLE * greatest(abs(top - level), abs(low - level)) AS high FROM i JOIN l USING (record, beat)),
g AS (SELECT record, beat, top - low AS amp, (max(idx) FILTER (WHERE high) - min(idx) FILTER (WHERE high) + 1) * 1000.0::DOUBLE / 16 AS ms, quantile_cont(step, 0.95) AS steep FROM h GROUP BY record, beat, top, low HAVING top - low > 1e-8)
SELECT record, count(*) AS beats, round(median(ms), 6) AS qrs_ms, round(quantile_cont(ms, 0.75) - quantile_cont(ms, 0.25), 6) AS qrs_iqr_ms, round(median(steep), 6) AS steepness, round(median(amp), 6) AS amplitude FROM g GROUP BY record""")
def ecg_qrs_widths(spark, sf_dir):
    rows, beat = _tops(spark, sf_dir)
    return op.qrs_widths(rows, beat, RATE)


_WAVES = f"""WITH {BEATS_SQL}, wv AS (SELECT record, t - (0.12::DOUBLE + x / 1000) AS p_on, t - (0.03::DOUBLE + x / 4000) AS qrs_on, t + (0.03::DOUBLE + x / 3000) AS qrs_off, t + (0.3::DOUBLE + x / 2000) AS t_off FROM beats),
du AS (SELECT record, CASE WHEN qrs_on - p_on BETWEEN 0.06::DOUBLE AND 0.32::DOUBLE THEN 1000 * (qrs_on - p_on) END AS pr, CASE WHEN qrs_off - qrs_on BETWEEN 0.04::DOUBLE AND 0.18::DOUBLE THEN 1000 * (qrs_off - qrs_on) END AS qrs,
  CASE WHEN t_off - qrs_on BETWEEN 0.18::DOUBLE AND 0.65::DOUBLE THEN 1000 * (t_off - qrs_on) END AS qt FROM wv),
md AS (SELECT record, count(*) AS n, median(pr) AS pr, median(qrs) AS qrs, median(qt) AS qt, count(qrs) AS n_qrs, count(qt) AS n_qt FROM du GROUP BY record),
iv AS (SELECT record, t - lag(t) OVER (PARTITION BY record ORDER BY idx) AS dt FROM beats), cy AS (SELECT record, median(dt) AS rr FROM iv WHERE dt > 0 AND dt BETWEEN 0.3 AND 2.5 GROUP BY record),
al AS (SELECT md.*, qt / sqrt(rr) AS qtc, qt / cbrt(rr) AS qtf FROM md LEFT JOIN cy USING (record)),
fl AS (SELECT record, n, round(pr, 6) AS pr_ms, round(qrs, 6) AS qrs_ms, round(qt, 6) AS qt_ms, round(qtc, 6) AS qtc_ms, round(qtf, 6) AS qtc_cube_ms,
  list_filter([CASE WHEN qrs > 120 THEN 'wide_qrs' END, CASE WHEN qtc > 470 THEN 'long_qtc' END, CASE WHEN pr > 220 THEN 'long_pr' END], lambda z: z IS NOT NULL) AS f,
  list_filter([CASE WHEN n_qrs < greatest(3, floor(0.25 * n)) THEN 'few_qrs' END, CASE WHEN n_qt < greatest(3, floor(0.2 * n)) THEN 'few_qt' END], lambda z: z IS NOT NULL) AS q FROM al)"""


@query("ecg_wave_intervals", f"""{_WAVES} SELECT record, n, pr_ms, qrs_ms, qt_ms, qtc_ms, qtc_cube_ms, array_to_string(f, ',') AS flags, array_to_string(q, ',') AS quality_flags, CASE WHEN len(f) > 0 THEN 'elevated' ELSE 'low' END AS risk FROM fl""")
def ecg_wave_intervals(spark, sf_dir):
    rows = beats(spark, sf_dir)
    t, x = F.col("t"), F.col("x")
    waves = rows.select("record", (t - (0.12 + x / 1000)).alias("p_on"), (t - (0.03 + x / 4000)).alias("qrs_on"), (t + (0.03 + x / 3000)).alias("qrs_off"), (t + (0.3 + x / 2000)).alias("t_off"))
    return op.wave_intervals(waves, intervals.intervals(rows), rows.groupBy("record").agg(F.count("*").alias("n")))


@query("ecg_conduction", f"""{_WAVES}, cf AS (SELECT record, pr_ms, qrs_ms, list_filter([CASE WHEN pr_ms > 300 THEN 'marked_pr_prolongation' END, CASE WHEN pr_ms > 220 AND pr_ms <= 300 THEN 'first_degree_block' END,
  CASE WHEN qrs_ms >= 120 THEN 'wide_qrs' END, CASE WHEN qrs_ms >= 110 AND qrs_ms < 120 THEN 'borderline_qrs' END], lambda z: z IS NOT NULL) AS f FROM fl)
SELECT record, pr_ms, qrs_ms, array_to_string(f, ',') AS flags, CASE WHEN len(f) > 0 THEN 'elevated' ELSE 'low' END AS risk FROM cf""")
def ecg_conduction(spark, sf_dir):
    return op.conduction_screen(ecg_wave_intervals(spark, sf_dir))
