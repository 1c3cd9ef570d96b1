"""Queries on scores: order lines are cases with a score, events in stretches of eight are windows of a record."""

from ..operators import scoring as op
from ..sources.tables import BEATS_SQL, beats, table
from . import query
from pyspark.sql import functions as F

CASES = "WITH s AS (SELECT l_suppkey % 50 AS g, l_returnflag = 'R' AS t, l_quantity - 20 * l_discount AS s, l_linestatus = 'F' AS p FROM lineitem)"


def cases(spark, sf_dir):
    """Cases of many groups with tied scores."""
    line = table(spark, sf_dir, "lineitem")
    return line.select((F.col("l_suppkey") % 50).alias("group"), (F.col("l_returnflag") == "R").alias("truth"), (F.col("l_quantity") - 20 * F.col("l_discount")).alias("score"), (F.col("l_linestatus") == "F").alias("pred"))


@query("auroc_by_group", CASES + """, k AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2.0::DOUBLE AS r FROM s),
a AS (SELECT g, count(*) FILTER (WHERE t) AS p, count(*) FILTER (WHERE NOT t) AS n, sum(r) FILTER (WHERE t) AS r FROM k GROUP BY g)
SELECT g AS "group", p AS positives, n AS negatives, CASE WHEN p > 0 AND n > 0 THEN round((r - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * n), 6) END AS auroc FROM a""")
def auroc_by_group(spark, sf_dir):
    return op.auroc(cases(spark, sf_dir))


@query("average_precision", CASES + """, d AS (SELECT g, s, count(*) FILTER (WHERE t) AS p, count(*) AS n FROM s GROUP BY 1, 2),
c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY g) AS tp FROM d WINDOW w AS (PARTITION BY g ORDER BY s DESC))
SELECT g AS "group", any_value(tp)::BIGINT AS positives, CASE WHEN any_value(tp) > 0 THEN round(sum(p * cp / cn) / any_value(tp), 6) END AS average_precision, round(max(CASE WHEN cp > 0 THEN 2 * cp / (tp + cn) END), 6) AS best_f1 FROM c GROUP BY g""")
def average_precision(spark, sf_dir):
    return op.average_precision(cases(spark, sf_dir))


@query("cohen_kappa", CASES + """, c AS (SELECT g, t, p, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT g, sum(n)::DOUBLE AS n, sum(n) FILTER (WHERE t = p)::DOUBLE AS s, sum(n) FILTER (WHERE t)::DOUBLE AS a, sum(n) FILTER (WHERE p)::DOUBLE AS b FROM c GROUP BY g),
k AS (SELECT g, n, coalesce(s, 0) / n AS po, (coalesce(a, 0) * coalesce(b, 0) + (n - coalesce(a, 0)) * (n - coalesce(b, 0))) / n / n AS pe FROM m)
SELECT g AS "group", n::BIGINT AS n, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1.0::DOUBLE END, 6) AS kappa FROM k""")
def cohen_kappa(spark, sf_dir):
    return op.cohen_kappa(cases(spark, sf_dir))


FEATURES = ["level", "spread", "low", "clicks"]
WINDOWS_SQL = f"""WITH {BEATS_SQL}, w AS (SELECT record, (idx - 1) // 8 AS w, avg(x) AS level, stddev_pop(x) AS spread, min(x) AS low, count(*) FILTER (WHERE kind = 'click') AS clicks, max(x) > 40 AND count(*) FILTER (WHERE kind = 'error') > 0 AS truth FROM beats GROUP BY 1, 2)"""


def windows(spark, sf_dir):
    """Stretches of eight events of a record: figures of their values, and whether one was an error and one high."""
    rows = beats(spark, sf_dir).withColumn("w", F.floor((F.col("idx") - 1) / 8))
    return rows.groupBy(F.col("record").alias("group"), "w").agg(
        F.avg("x").alias("level"), F.stddev_pop("x").alias("spread"), F.min("x").alias("low"), F.count_if(F.col("kind") == "click").alias("clicks"), ((F.max("x") > 40) & (F.count_if(F.col("kind") == "error") > 0)).alias("truth")
    )


@query("grouped_cv_scores")
def grouped_cv_scores(spark, sf_dir):
    return op.cross_validated(windows(spark, sf_dir), FEATURES).select("group", "w", "fold", "truth", "score")


@query("cv_auroc_by_fold")
def cv_auroc_by_fold(spark, sf_dir):
    """How well out-of-fold scores rank the windows of each fold."""
    return op.auroc(grouped_cv_scores(spark, sf_dir).select(F.col("fold").alias("group"), "truth", "score"))
