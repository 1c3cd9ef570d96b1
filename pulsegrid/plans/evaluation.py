"""Evaluation queries over documents, labels, benchmark items, orders and events."""

from ..functions.columns import r6
from ..operators import evaluation as op
from ..sources.tables import BEATS_SQL, beats, table
from . import query
from pyspark.sql import functions as F

#: Rules of the keyword planner: words of the four languages of the questions stand for topics.
RULES = (("the", "quality_check", 1), ("und", "rate_estimate", 2), ("de", "rhythm_screen", 3), ("la", "interval_measure", 4), ("in", "artifact_check", 5),
         ("que", "respiration_estimate", 6), ("die", "burden_summary", 7), ("of", "report", 8), ("le", "report", 9), ("es", "trend", 10))
RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}', {p})" for k, t, p in RULES) + ") AS r(keyword, tool, priority))"
TOK = "regexp_extract_all(lower(replace(text, '-', '_')), '[a-z0-9_]+')"


def _pairs(spark, sf_dir):
    """Quality labels against a length threshold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return labels.join(docs.select("doc_id", "n_chars"), "doc_id")


@query("confusion_metrics", """WITH p AS (SELECT quality = 1 AS t, n_chars > 1200 AS p FROM labels JOIN documents USING (doc_id)),
a AS (SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn FROM p)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall,
  round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1 FROM a""")
def confusion_metrics(spark, sf_dir):
    return op.confusion(_pairs(spark, sf_dir).select((F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 1200).alias("pred")))


@query("macro_f1", """WITH p AS (SELECT quality * 2 + toxic AS t, CASE WHEN n_chars > 2500 THEN 2 WHEN n_chars > 1200 THEN 0 ELSE 1 END AS p FROM labels JOIN documents USING (doc_id)),
l AS (SELECT t AS label, 1 AS s, 0 AS q, (t = p)::INT AS hit FROM p UNION ALL SELECT p, 0, 1, 0 FROM p),
e AS (SELECT label, sum(s) AS support, sum(q) AS predicted, sum(hit) AS tp FROM l GROUP BY label HAVING sum(s) > 0), f AS (SELECT *, 2 * tp / (support + predicted)::DOUBLE AS f FROM e)
SELECT label, support::BIGINT AS support, round(coalesce(tp / nullif(predicted, 0)::DOUBLE, 0), 6) AS precision, round(tp / support::DOUBLE, 6) AS recall, round(f, 6) AS f1, round(avg(f) OVER (), 6) AS macro_f1 FROM f""")
def macro_f1(spark, sf_dir):
    pred = F.when(F.col("n_chars") > 2500, 2).when(F.col("n_chars") > 1200, 0).otherwise(1)
    return op.macro_f1(_pairs(spark, sf_dir).select((F.col("quality") * 2 + F.col("toxic")).alias("truth"), pred.alias("pred")))


TFIDF = f"""WITH h AS (SELECT id, token, count(*) AS tf FROM (SELECT doc_id AS id, unnest({TOK}) AS token FROM documents) GROUP BY 1, 2),
q AS (SELECT q, token, count(*) AS m FROM (SELECT item_id AS q, unnest({TOK}) AS token FROM benchmark) GROUP BY 1, 2),
i AS (SELECT token, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM h GROUP BY token),
s AS (SELECT q, id, round(sum(m * (1 + ln(tf)) * idf), 6) AS score FROM q JOIN i USING (token) JOIN h USING (token) GROUP BY 1, 2),
r AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s)"""


def _catalog(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")


@query("tfidf_topk", TFIDF + " SELECT q, id, score, rank FROM r WHERE rank <= 5")
def tfidf_topk(spark, sf_dir):
    return op.tfidf_top(_items(spark, sf_dir), _catalog(spark, sf_dir), 5)


@query("token_overlap_replay", f"""WITH k AS (SELECT DISTINCT id, token FROM (SELECT doc_id AS id, unnest({TOK}) AS token FROM documents)), q AS (SELECT DISTINCT q, token FROM (SELECT item_id AS q, unnest({TOK}) AS token FROM benchmark)),
e AS (SELECT item_id AS q, min(doc_id) AS same FROM benchmark JOIN documents USING (text) GROUP BY 1),
n AS (SELECT q, id, count(*) AS n, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, id) AS k FROM q JOIN k USING (token) GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT b.item_id AS q, coalesce(same, id) AS id, CASE WHEN same IS NULL THEN n END AS shared, CASE WHEN same IS NOT NULL THEN 'exact' WHEN id IS NOT NULL THEN 'overlap' ELSE 'none' END AS how
FROM benchmark b LEFT JOIN e ON e.q = b.item_id LEFT JOIN n ON n.q = b.item_id AND n.k = 1""")
def token_overlap_replay(spark, sf_dir):
    return op.replay(_items(spark, sf_dir), _catalog(spark, sf_dir))


@query("keyword_planner", f"""WITH {RULES_SQL}, c AS (SELECT conv_id * 1000 + turn AS q, text FROM conversations WHERE role = 'user'),
w AS (SELECT DISTINCT q, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS keyword FROM c), f AS (SELECT q, tool, min(priority) AS p FROM w JOIN rules USING (keyword) GROUP BY 1, 2),
p AS (SELECT q, string_agg(tool, ',' ORDER BY p, tool) AS plan, count(*) AS tools FROM f GROUP BY q)
SELECT q, coalesce(plan, '') AS plan, coalesce(tools, 0) AS tools FROM c LEFT JOIN p USING (q)""")
def keyword_planner(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("q"), "text")
    return op.plan_by_keywords(q, spark.createDataFrame(list(RULES), "keyword string, tool string, priority int"))


@query("set_prf", """WITH e AS (SELECT l_orderkey AS id, list(DISTINCT l_suppkey % 7) FILTER (WHERE l_linenumber <= 3) AS e, list(DISTINCT l_suppkey % 7) FILTER (WHERE l_linenumber >= 3) AS p FROM lineitem GROUP BY 1),
s AS (SELECT id, coalesce(len(e), 0) AS e, coalesce(len(p), 0) AS p, coalesce(len(list_intersect(e, p)), 0) AS hit FROM e),
r AS (SELECT id, CASE WHEN e = 0 AND p = 0 THEN 1.0::DOUBLE ELSE coalesce(hit / nullif(p, 0)::DOUBLE, 0) END AS precision, CASE WHEN e = 0 AND p = 0 THEN 1.0::DOUBLE ELSE coalesce(hit / nullif(e, 0)::DOUBLE, 0) END AS recall FROM s)
SELECT id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM r""")
def set_prf(spark, sf_dir):
    tool, n = F.col("l_suppkey") % 7, F.col("l_linenumber")
    cases = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.when(n <= 3, tool)).alias("expected"), F.collect_set(F.when(n >= 3, tool)).alias("planned"))
    return op.set_scores(cases)


@query("recall_at_k", """WITH r AS (SELECT l_orderkey AS q, l_returnflag = 'R' AS rel, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem),
a AS (SELECT *, count(*) FILTER (WHERE rel) OVER (PARTITION BY q) AS n FROM r),
e AS (SELECT q, count(*) FILTER (WHERE rel AND rank <= 1) / any_value(n)::DOUBLE AS r1, count(*) FILTER (WHERE rel AND rank <= 3) / any_value(n)::DOUBLE AS r3, count(*) FILTER (WHERE rel AND rank <= 5) / any_value(n)::DOUBLE AS r5,
  avg(CASE WHEN rel THEN 1.0::DOUBLE / rank END) AS mrr FROM a WHERE n > 0 GROUP BY q)
SELECT count(*) AS queries, round(avg(r1), 6) AS recall_at_1, round(avg(r3), 6) AS recall_at_3, round(avg(r5), 6) AS recall_at_5, round(avg(mrr), 6) AS mrr FROM e""")
def recall_at_k(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    ranked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), rank.alias("rank"), (F.col("l_returnflag") == "R").alias("relevant"))
    return op.recall_at(ranked, [1, 3, 5])


@query("grouped_summary", """SELECT o_orderpriority AS task, o_orderstatus AS input, CASE WHEN GROUPING(o_orderpriority) = 1 AND GROUPING(o_orderstatus) = 1 THEN 'overall' WHEN GROUPING(o_orderpriority) = 0 AND GROUPING(o_orderstatus) = 0 THEN 'both'
  WHEN GROUPING(o_orderpriority) = 0 THEN 'task' ELSE 'input' END AS level, count(*) AS cases, round(avg((o_totalprice > 150000)::INT), 6) AS accuracy, round(avg(o_totalprice), 2) AS mean_price FROM orders
GROUP BY GROUPING SETS ((), (o_orderpriority), (o_orderstatus), (o_orderpriority, o_orderstatus))""")
def grouped_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({"task": F.col("o_orderpriority"), "input": F.col("o_orderstatus")})
    t, i = F.grouping("task") == 1, F.grouping("input") == 1
    level = F.when(t & i, "overall").when(~t & ~i, "both").when(~t, "task").otherwise("input")
    sets = o.groupingSets([[], ["task"], ["input"], ["task", "input"]], "task", "input")
    return sets.agg(level.alias("level"), F.count("*").alias("cases"), r6(F.avg((F.col("o_totalprice") > 150000).cast("int"))).alias("accuracy"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"))


@query("hash_split", """WITH c AS (SELECT o_orderkey AS id, o_orderpriority AS task, o_orderstatus AS modality FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY task, modality ORDER BY sha256('s1:' || id || ':' || task || ':' || modality)) AS k, count(*) OVER (PARTITION BY task, modality) AS n FROM c),
m AS (SELECT *, CASE WHEN n >= 5 THEN greatest(1, round_even(0.2 * n, 0)) ELSE 0 END AS held, CASE WHEN n >= 8 THEN greatest(1, round_even(0.1 * n, 0)) ELSE 0 END AS dev FROM k)
SELECT id, task, modality, CASE WHEN k <= held THEN 'held_out' WHEN k <= held + dev THEN 'dev' ELSE 'train' END AS split FROM m""")
def hash_split(spark, sf_dir):
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("modality"))
    return op.hash_split(cases, "s1")


@query("constraint_report", """SELECT 'orphan_line' AS "check", CAST(l_orderkey AS VARCHAR) AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
UNION ALL SELECT 'repeated_part', CAST(l_partkey AS VARCHAR) FROM lineitem GROUP BY l_partkey HAVING count(*) > 35 UNION ALL SELECT 'unknown_status', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""")
def constraint_report(spark, sf_dir):
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return op.violations(
        orphan_line=line.select("l_orderkey").join(orders.where("o_orderstatus <> 'F'"), line["l_orderkey"] == orders["o_orderkey"], "left_anti"),
        repeated_part=line.groupBy("l_partkey").count().where("count > 35").select("l_partkey"),
        unknown_status=orders.where(~F.col("o_orderstatus").isin("O", "F")).select("o_orderkey"),
    )


@query("relational_division", """SELECT user_id AS record, count(DISTINCT event_type) AS kinds FROM events WHERE event_type IN ('view', 'click', 'error', 'purchase') AND value > 20 GROUP BY 1 HAVING count(DISTINCT event_type) = 4""")
def relational_division(spark, sf_dir):
    return op.having_all(beats(spark, sf_dir).where("x > 20"), ["view", "click", "error", "purchase"])


@query("first_per_key", f"WITH {BEATS_SQL} SELECT record, kind, idx, round(x, 6) AS x FROM beats QUALIFY row_number() OVER (PARTITION BY record, kind ORDER BY idx) = 1")
def first_per_key(spark, sf_dir):
    return op.first_per_key(beats(spark, sf_dir), ["record", "kind"], ["idx"]).select("record", "kind", "idx", r6("x").alias("x"))


@query("numeric_grounding", """WITH n AS (SELECT event_id AS id, list_transform(regexp_extract_all(props, '-?[0-9]+(?:\\.[0-9]+)?'), lambda s: s::DOUBLE) AS said, [value, value / 2] AS known FROM events),
s AS (SELECT id, len(said) AS n, len(list_filter(said, lambda v: len(list_filter(known, lambda k: abs(v - k) <= greatest(0.15, 0.015 * abs(k)))) > 0)) AS supported FROM n)
SELECT id, n, supported, round(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE supported / n::DOUBLE END, 6) AS grounded FROM s""")
def numeric_grounding(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return op.grounding(e.select(F.col("event_id").alias("id"), F.col("props").alias("text"), F.array(F.col("value"), F.col("value") / 2).alias("known")))


_TOPICS = ("en", "de", None)


@query("tool_retrieval", f"""WITH cat AS (SELECT doc_id AS id, source AS name, lower(lang) AS of, text FROM documents), qs AS (SELECT item_id AS q, text, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS modality FROM benchmark),
h AS (SELECT id, name, of, token, count(*) AS tf FROM (SELECT id, name, of, unnest({TOK}) AS token FROM cat) GROUP BY ALL), a AS (SELECT q, modality, token, count(*) AS m FROM (SELECT q, modality, unnest({TOK}) AS token FROM qs) GROUP BY ALL),
i AS (SELECT token, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM h GROUP BY token),
hits AS (SELECT q, id, name, m * idf * (1 + ln(tf)) AS part FROM a JOIN i USING (token) JOIN h USING (token) WHERE modality IS NULL OR of = 'any' OR of = modality),
named AS (SELECT DISTINCT q, id, name, 0.5::DOUBLE AS part FROM (SELECT id, name, of, unnest(string_split_regex(lower(name), '[ _-]+')) AS token FROM cat) JOIN a USING (token) WHERE modality IS NULL OR of = 'any' OR of = modality),
f AS (SELECT *, row_number() OVER (PARTITION BY of ORDER BY name, id) AS nth FROM cat), fill AS (SELECT q, id, name, 0.0::DOUBLE AS part FROM f JOIN qs ON of = modality OR of = 'any' AND modality IS NOT NULL WHERE nth <= 10),
s AS (SELECT q, id, name, round(sum(part), 6) AS score FROM (SELECT * FROM hits UNION ALL SELECT * FROM named UNION ALL SELECT * FROM fill) GROUP BY ALL)
SELECT q, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, name, id) AS rank FROM s) WHERE rank <= 5""")
def tool_retrieval(spark, sf_dir):
    topic = F.element_at(F.array(*[F.lit(t) for t in _TOPICS]), (F.col("item_id") % 3 + 1).cast("int"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text", topic.alias("modality"))
    catalog = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("lang").alias("modality"), "text")
    return op.retrieve(asked, catalog, 5)
