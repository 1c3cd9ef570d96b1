"""Catalog, routing, clustering and sequence queries."""

from ..functions.columns import r6
from ..operators import catalog as op
from ..sources.tables import BEATS_SQL, SAMPLES_SQL, beats, samples, table
from . import query
from pyspark.sql import functions as F

HINTS = {"ecg": ["the", "heart"], "ppg": ["und", "die"], "resp": ["de ", "la "], "eeg": ["ción", "que"]}
HINT_SQL = ", ".join(f"[{' + '.join(f'contains(lower(text), {w!r})::INT' for w in words)}, {-k}]" for k, words in enumerate(HINTS.values()))


@query("source_index", """SELECT tool, len(s) AS n, array_to_string(s, ',') AS sources FROM (SELECT l_partkey AS tool, list_sort(list(DISTINCT l_suppkey::VARCHAR)) AS s FROM lineitem GROUP BY 1)""")
def source_index(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("source"), F.array("l_partkey").alias("tools"))
    return op.inverted_index(e)


@query("tool_universe", """WITH t AS (SELECT p_partkey AS tool, p_partkey % 12 AS modality, p_partkey % 3 AS kind FROM part), s AS (SELECT DISTINCT l_partkey AS tool, 1 AS known FROM lineitem WHERE l_quantity > 45)
SELECT modality, kind, CASE WHEN GROUPING(modality) = 1 AND GROUPING(kind) = 1 THEN 'overall' WHEN GROUPING(modality) = 0 AND GROUPING(kind) = 0 THEN 'both' WHEN GROUPING(modality) = 0 THEN 'modality' ELSE 'kind' END AS level,
  count(*) AS tools, count(known) AS with_source FROM t LEFT JOIN s USING (tool) GROUP BY GROUPING SETS ((), (modality), (kind), (modality, kind))""")
def tool_universe(spark, sf_dir):
    k = F.col("p_partkey")
    tools = table(spark, sf_dir, "part").select(k.alias("tool"), (k % 12).alias("modality"), (k % 3).alias("kind"))
    return op.universe(tools, table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("tool")))


@query("dependency_closure", """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS tool, p_partkey // 2 AS needs FROM part WHERE p_partkey > 1), c AS (SELECT tool, needs FROM e UNION SELECT c.tool, e.needs FROM c JOIN e ON c.needs = e.tool) SELECT tool, needs FROM c""")
def dependency_closure(spark, sf_dir):
    k = F.col("p_partkey")
    return op.closure(table(spark, sf_dir, "part").where("p_partkey > 1").select(k.alias("tool"), F.floor(k / 2).alias("needs")))


@query("infer_modality", f"""WITH c AS (SELECT conv_id * 1000 + turn AS q, text FROM conversations WHERE role = 'user'), h AS (SELECT q, list_max([{HINT_SQL}]) AS b FROM c)
SELECT q, b[1] AS hits, CASE WHEN b[1] > 0 THEN ['ecg', 'ppg', 'resp', 'eeg'][1 - b[2]] ELSE 'unknown' END AS modality FROM h""")
def infer_modality(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("q"), "text")
    return op.infer_modality(q, HINTS)


@query("failure_reasons", """SELECT o_orderkey AS id, CASE WHEN NOT (o_totalprice > 20000) THEN 'retrieval_missed' WHEN o_orderkey % 3 = 1 THEN 'plan_missing_tools' WHEN o_orderkey % 5 = 1 THEN 'plan_has_unexpected_tools' WHEN o_orderstatus <> 'F' THEN 'execution_failed' ELSE 'ok' END AS reason FROM orders""")
def failure_reasons(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("id"), (k % 3 == 1).cast("int").alias("missing"), (k % 5 == 1).cast("int").alias("unexpected"), (F.col("o_orderstatus") == "F").alias("executed"), (F.col("o_totalprice") > 20000).alias("retrieved"))
    return op.failure_reasons(o)


CLUSTERS = f"""WITH {BEATS_SQL}, n AS (SELECT record, x, coalesce((x - lag(x) OVER (PARTITION BY record ORDER BY x) > 2)::INT, 1) AS new FROM beats), g AS (SELECT *, sum(new) OVER (PARTITION BY record ORDER BY x ROWS UNBOUNDED PRECEDING) AS cluster FROM n),
k AS (SELECT record, cluster::BIGINT AS cluster, count(*) AS n, round(avg(x), 6) AS centre, round(max(x) - min(x), 6) AS span FROM g GROUP BY 1, 2)"""


@query("gap_clusters", CLUSTERS + " SELECT * FROM k")
def gap_clusters(spark, sf_dir):
    return op.gap_clusters(beats(spark, sf_dir).select("record", "x"), 2.0)


@query("median_spacing", CLUSTERS + ", d AS (SELECT record, centre - lag(centre) OVER (PARTITION BY record ORDER BY centre) AS d FROM k) SELECT record, count(*) AS gaps, round(median(d), 6) AS spacing FROM d WHERE d > 4 GROUP BY record")
def median_spacing(spark, sf_dir):
    return op.median_spacing(gap_clusters(spark, sf_dir), 4.0)


@query("tick_durations", r"""WITH n AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?'), lambda s: s::DOUBLE)) AS n FROM documents)
SELECT doc_id, round(list_max(n) - list_min(n), 6) AS duration FROM n WHERE len(n) >= 4""")
def tick_durations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", r6(op.tick_duration(F.col("text"))).alias("duration"))
    return d.where("duration is not null")


@query("peak_trough_cycles", f"""WITH {SAMPLES_SQL}, e AS (SELECT *, x > lag(x) OVER w AND x >= lead(x) OVER w AS hi, x < lag(x) OVER w AND x <= lead(x) OVER w AS lo FROM samples WINDOW w AS (PARTITION BY record ORDER BY idx)),
n AS (SELECT *, last_value(CASE WHEN hi THEN x END IGNORE NULLS) OVER (PARTITION BY record ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  first_value(CASE WHEN hi THEN x END IGNORE NULLS) OVER (PARTITION BY record ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM e)
SELECT record, idx, round(x, 6) AS low, round(a, 6) AS high_before, round(b, 6) AS high_after, round(least(a, b) - x, 6) AS depth FROM n WHERE lo AND a IS NOT NULL AND b IS NOT NULL""")
def peak_trough_cycles(spark, sf_dir):
    return op.extremes(samples(spark, sf_dir))


@query("rate_consensus", """WITH c AS (SELECT user_id AS record, round_even(round(value, 2) / 1.875, 0) * 1.875::DOUBLE AS bin, count(DISTINCT event_type) AS sources, round(sum(value / 100), 6) AS power FROM events GROUP BY 1, 2)
SELECT record, round(bin, 6) AS rate, sources, power FROM c QUALIFY row_number() OVER (PARTITION BY record ORDER BY sources DESC, power DESC, bin) = 1""")
def rate_consensus(spark, sf_dir):
    return op.rate_consensus(beats(spark, sf_dir).select("record", F.col("kind").alias("source"), F.round("x", 2).alias("rate"), (F.col("x") / 100).alias("power")))


@query("ranked_candidates", """WITH r AS (SELECT l_orderkey AS record, l_linenumber AS value, floor(l_extendedprice) AS power, rank() OVER (PARTITION BY l_orderkey ORDER BY floor(l_extendedprice) DESC) - 1 AS rank FROM lineitem) SELECT record, value, rank, round(power * pow(0.5::DOUBLE, rank), 6) AS support FROM r""")
def ranked_candidates(spark, sf_dir):
    return op.ranked_candidates(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("value"), F.floor("l_extendedprice").alias("power")), 0.5)


@query("grouped_folds", "SELECT o_orderkey AS id, o_custkey AS \"group\", ('0x' || substring(md5(o_custkey::VARCHAR), 1, 8))::BIGINT % 5 AS fold FROM orders")
def grouped_folds(spark, sf_dir):
    return op.folds(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("group")), 5)


@query("context_stack", f"""WITH {BEATS_SQL}, w AS (SELECT record, idx, x, coalesce(lag(x, 2) OVER o, first_value(x) OVER a) AS p2, coalesce(lag(x) OVER o, first_value(x) OVER a) AS p1, coalesce(lead(x) OVER o, last_value(x) OVER a) AS n1, coalesce(lead(x, 2) OVER o, last_value(x) OVER a) AS n2
  FROM beats WINDOW o AS (PARTITION BY record ORDER BY idx), a AS (PARTITION BY record ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT record, idx, round(p2 + p1 + x + n1 + n2, 6) AS total, round(p2, 6) AS first FROM w""")
def context_stack(spark, sf_dir):
    rows = op.context_stack(beats(spark, sf_dir), 2)
    total = F.aggregate("context", F.lit(0.0), lambda a, b: a + b)
    return rows.select("record", "idx", r6(total).alias("total"), r6(F.col("context")[0]).alias("first"))


@query("padded_sequences", f"""WITH {BEATS_SQL}, m AS (SELECT *, median(x) OVER (PARTITION BY record) AS m FROM beats), z AS (SELECT record, idx, round(least(greatest(coalesce((x - m) / nullif(1.4826::DOUBLE * median(abs(x - m)) OVER (PARTITION BY record), 0), 0), -6), 6), 6) AS z FROM m)
SELECT record, count(*) AS n, round(sum(z), 6) AS total FROM z WHERE idx <= 40 GROUP BY record""")
def padded_sequences(spark, sf_dir):
    rows = op.padded_sequences(beats(spark, sf_dir), 40)
    return rows.select("record", "n", r6(F.aggregate("sequence", F.lit(0.0), lambda a, b: a + b)).alias("total"))


def _has(c: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query("tool_profile", f"""WITH t AS (SELECT doc_id AS tool, lang = 'image' AS image, lower(source) AS name, lower(concat_ws(' ', source, text)) AS t FROM documents),
e AS (SELECT *, CASE WHEN {_has("t", "proxy")} THEN 'proxy' WHEN {_has("t", "trained", "benchmark", "auroc", "f1", "mae")} THEN 'benchmarked' WHEN {_has("t", "quality", "detect", "compute", "summarize", "estimate")} THEN 'algorithmic' ELSE 'experimental' END AS evidence FROM t)
SELECT tool, CASE WHEN {_has("t", "_dl", "_cnn", "_ml", "deep", "model", "classif")} THEN 'learned' WHEN {_has("t", "proxy", "screen_", "estimate_", "risk")} THEN 'rule' ELSE 'signal_processing' END AS kind, evidence,
  array_to_string(list_filter(['artifact_or_motion', CASE WHEN {_has("name", "peak", "hrv")} THEN 'false_peaks' END, 'low_signal_quality', CASE WHEN {_has("name", "digitize")} OR image THEN 'missing_axis_scale' END, CASE WHEN {_has("name", "peak", "hrv")} THEN 'missed_peaks' END,
    'out_of_distribution', CASE WHEN {_has("name", "proxy", "screen")} THEN 'proxy_not_diagnostic' END, CASE WHEN {_has("name", "digitize")} OR image THEN 'unclear_trace' END], lambda z: z IS NOT NULL), ',') AS failure_modes,
  CASE WHEN evidence = 'proxy' THEN 'screening_only' WHEN image THEN 'depends_on_visible_trace' WHEN evidence = 'benchmarked' THEN 'validated_on_listed_data' ELSE 'check_signal_quality' END AS limitation FROM e""")
def tool_profile(spark, sf_dir):
    return op.tool_profile(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tool"), F.col("lang").alias("modality"), F.col("source").alias("name"), "text"))


_TOOLS = ("ecg_assess_quality", "ppg_detect_ml", "signal_classify_modality", "image_estimate_scale", "image_digitize", "resp_rate_proxy", "spo2_summary")
_TOOL_SQL = "[" + ", ".join(f"'{t}'" for t in _TOOLS) + "]"


def _plans(spark, sf_dir, where: str):
    """For each order the tools of its lines, in order."""
    name = F.element_at(F.array(*[F.lit(t) for t in _TOOLS]), (F.col("l_suppkey") % len(_TOOLS) + 1).cast("int"))
    line = F.struct("l_linenumber", name.alias("tool"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.when(F.expr(where), line))).alias("lines"))
    return rows.select("id", F.transform("lines", lambda s: s["tool"]).alias("tools"))


@query("plan_ablation", f"""WITH p AS (SELECT l_orderkey AS id, list({_TOOL_SQL}[l_suppkey % 7 + 1] ORDER BY l_linenumber, {_TOOL_SQL}[l_suppkey % 7 + 1]) AS tools FROM lineitem GROUP BY 1),
d AS (SELECT id, list_filter(tools, lambda t, i: list_position(tools, t) = i) AS tools FROM p), k AS (SELECT id, tools, list_filter(tools, lambda t: NOT ({_has("t", "_dl", "_cnn", "_ml", "classify")})) AS kept FROM d)
SELECT id, len(tools) AS before, len(kept) AS after, array_to_string(kept, ',') AS tools FROM k""")
def plan_ablation(spark, sf_dir):
    return op.ablate(_plans(spark, sf_dir, "true"), "learned")


@query("missing_tool_categories", f"""WITH p AS (SELECT l_orderkey AS id, array_to_string(list({_TOOL_SQL}[l_suppkey % 7 + 1] ORDER BY l_linenumber) FILTER (WHERE l_quantity > 40), ' ') AS m FROM lineitem GROUP BY 1),
c AS (SELECT id, m, CASE o_orderstatus WHEN 'F' THEN 'session' ELSE 'text' END AS input, o_orderpriority AS modality FROM p JOIN orders ON o_orderkey = id WHERE m IS NOT NULL)
SELECT id, 'plan_' || CASE WHEN contains(m, 'classify_modality') THEN 'modality_router' WHEN {_has("m", "scale", "ocr", "axis")} THEN 'scale_ocr' WHEN contains(m, 'digitize') THEN 'image_digitization' WHEN contains(m, 'quality') THEN 'quality_gate'
  WHEN {_has("m", "proxy", "screen")} THEN 'screening_or_proxy_tool' WHEN contains(modality, '+') OR input = 'session' THEN 'multimodal_tool' ELSE 'expected_tool' END || '_missing' AS category FROM c""")
def missing_tool_categories(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("rate").alias("task"), F.when(F.col("o_orderstatus") == "F", "session").otherwise("text").alias("input"), F.col("o_orderpriority").alias("modality"))
    return op.missing_categories(_plans(spark, sf_dir, "l_quantity > 40").withColumnRenamed("tools", "missing").join(orders, "id"), "plan")


@query("metric_snippets", f"""WITH n AS (SELECT doc_id AS id, list_filter(string_split(text, '. '), lambda z: {_has("lower(z)", "f1", "auroc", "accuracy", "mae", "recall", "specificity")}) AS f FROM documents)
SELECT id, len(f) AS n, array_to_string(f, ' | ') AS snippets FROM n""")
def metric_snippets(spark, sf_dir):
    return op.metric_snippets(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.split("text", r"\. ").alias("notes")))


_BACKENDS = ("none", "oracle", "retrieval", "replay", "rules")
_T = _TOOL_SQL + "[l_suppkey % 7 + 1]"


@query("plan_backends", f"""WITH c AS (SELECT l_orderkey AS id, coalesce(list({_T} ORDER BY l_linenumber, {_T}) FILTER (WHERE l_linenumber <= 2), []) AS expected, coalesce(list({_T} ORDER BY l_linenumber, {_T}) FILTER (WHERE l_quantity > 25), []) AS retrieved,
  coalesce(list({_T} ORDER BY l_linenumber, {_T}) FILTER (WHERE l_returnflag = 'R'), []) AS replayed, coalesce(list({_T} ORDER BY l_linenumber, {_T}) FILTER (WHERE l_discount < 0.05), []) AS ruled FROM lineitem GROUP BY 1),
b AS (SELECT *, unnest([{", ".join(f"'{b}'" for b in _BACKENDS)}]) AS backend FROM c),
p AS (SELECT id, backend, CASE backend WHEN 'none' THEN [] WHEN 'oracle' THEN expected WHEN 'retrieval' THEN retrieved WHEN 'replay' THEN CASE WHEN len(replayed) = 0 THEN ruled ELSE replayed END ELSE ruled END AS t, backend = 'replay' AND len(replayed) = 0 AS missed FROM b),
d AS (SELECT *, list_filter(t, lambda x, i: list_position(t, x) = i) AS u FROM p) SELECT id, backend, len(u) AS tools, array_to_string(u, ',') AS plan, CASE WHEN missed THEN 'replay_missed' ELSE '' END AS note FROM d""")
def plan_backends(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(t) for t in _TOOLS]), (F.col("l_suppkey") % len(_TOOLS) + 1).cast("int"))
    line = F.struct("l_linenumber", name.alias("tool"))
    of = lambda where: F.transform(F.array_sort(F.collect_list(F.when(F.expr(where), line))), lambda s: s["tool"])
    cases = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        of("l_linenumber <= 2").alias("expected"), of("l_quantity > 25").alias("retrieved"), of("l_returnflag = 'R'").alias("replayed"), of("l_discount < 0.05").alias("ruled")
    )
    return op.plan_cases(cases, list(_BACKENDS))


@query("session_samples", """WITH r AS (SELECT conv_id AS session, turn AS label, role AS modality, CASE WHEN turn % 2 = 0 THEN 'plan' ELSE 'reply' END AS tools, length(text) AS result, CASE WHEN role = 'assistant' THEN 'said ' || length(text) ELSE '' END AS report FROM conversations),
s AS (SELECT session, count(*) AS runs, list({'label': label, 'modality': modality, 'tools': tools} ORDER BY label, modality, tools, result) AS plans, list({'label': label, 'modality': modality, 'result': result} ORDER BY label, modality, tools, result) AS results,
  coalesce(string_agg(report, chr(10) || chr(10) ORDER BY label, modality, tools, result) FILTER (WHERE report <> ''), '') AS summary FROM r GROUP BY session)
SELECT session, runs, 'session_planning' AS task, to_json({'session': session})::VARCHAR AS request, to_json({'signal_plans': plans})::VARCHAR AS answer FROM s
UNION ALL SELECT session, runs, 'session_execution', to_json({'session': session, 'signal_plans': plans})::VARCHAR, to_json({'signal_results': results})::VARCHAR FROM s
UNION ALL SELECT session, runs, 'session_report', to_json({'session': session, 'signal_results': results})::VARCHAR, to_json({'summary': summary})::VARCHAR FROM s""")
def session_samples(spark, sf_dir):
    n = F.length("text")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("label"), F.col("role").alias("modality"), F.when(F.col("turn") % 2 == 0, "plan").otherwise("reply").alias("tools"), n.alias("result"),
        F.when(F.col("role") == "assistant", F.concat(F.lit("said "), n.cast("string"))).otherwise("").alias("report"),
    )
    return op.session_samples(rows)


@query("tool_levels", f"""SELECT doc_id AS tool, CASE WHEN {_has("lower(source)", "0", "1")} THEN 1 WHEN {_has("lower(source)", "5", "7")} THEN 3 ELSE 2 END::BIGINT AS level,
  CASE WHEN {_has("lower(source)", "0", "1")} THEN 'signal' WHEN {_has("lower(source)", "5", "7")} THEN 'task' ELSE 'representation' END AS layer FROM documents""")
def tool_levels(spark, sf_dir):
    return op.tool_levels(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tool"), F.col("source").alias("name")), ("0", "1"), ("5", "7"))
