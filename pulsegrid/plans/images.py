"""Image queries; order lines stand for the marked pixels of waveform images."""

from ..operators import images as op
from ..sources.tables import table
from . import query
from pyspark.sql import functions as F

PIXELS = """WITH px AS (SELECT l_suppkey % 97 AS image, l_partkey % 60 AS x, l_orderkey % 40 AS y, l_discount * 10 AS v FROM lineitem)"""


def pixels(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select((F.col("l_suppkey") % 97).alias("image"), (F.col("l_partkey") % 60).alias("x"), (F.col("l_orderkey") % 40).alias("y"), (F.col("l_discount") * 10).alias("v"))


@query("image_column_traces", PIXELS + " SELECT image, x, round(avg(y), 6) AS mean_y, median(y) AS median_y, count(*) AS pixels FROM px GROUP BY 1, 2")
def image_column_traces(spark, sf_dir):
    return op.column_traces(pixels(spark, sf_dir))


@query("image_filled_trace", PIXELS + """, t AS (SELECT image, x, median(y) AS y FROM px GROUP BY 1, 2 HAVING count(*) >= 10), d AS (SELECT s.image, s.x, y FROM (SELECT image, unnest(generate_series(min(x), max(x))) AS x FROM t GROUP BY image) s LEFT JOIN t USING (image, x)),
k AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER p AS x0, last_value(y IGNORE NULLS) OVER p AS y0, first_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER q AS x1, first_value(y IGNORE NULLS) OVER q AS y1 FROM d
  WINDOW p AS (PARTITION BY image ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY image ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT image, x, round(coalesce(y, y0 + (y1 - y0) * (x - x0) / (x1 - x0)::DOUBLE), 6) AS y, y IS NULL AS filled FROM k""")
def image_filled_trace(spark, sf_dir):
    return op.filled_trace(pixels(spark, sf_dir), least=10)


@query("image_profile_peaks", PIXELS + """, p AS (SELECT image, x, sum(y) AS p FROM px GROUP BY 1, 2),
w AS (SELECT *, lag(p) OVER (PARTITION BY image ORDER BY x) AS b, lead(p) OVER (PARTITION BY image ORDER BY x) AS a, avg(p) OVER (PARTITION BY image) + stddev_pop(p) OVER (PARTITION BY image) AS lim FROM p)
SELECT image, count(*) AS lines, count(*) FILTER (WHERE p > b AND p >= a AND p > lim) AS peaks FROM w GROUP BY image""")
def image_profile_peaks(spark, sf_dir):
    return op.profile_peaks(pixels(spark, sf_dir).withColumn("v", F.col("y")), "x")


@query("image_entropy", PIXELS + """, c AS (SELECT image, least(floor((y / 40.0::DOUBLE) * 8), 7) AS bin, count(*) AS n FROM px GROUP BY 1, 2), p AS (SELECT image, n / sum(n) OVER (PARTITION BY image) AS p FROM c)
SELECT image, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS bins FROM p GROUP BY image""")
def image_entropy(spark, sf_dir):
    return op.intensity_entropy(pixels(spark, sf_dir).withColumn("v", F.col("y") / 40.0), 8)


@query("image_layout", PIXELS + """, a AS (SELECT image, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(DISTINCT x * 1000 + y) AS n, count(DISTINCT x) AS c FROM px GROUP BY 1)
SELECT image, width, height, round(n / (width * height)::DOUBLE, 6) AS density, round(n / c::DOUBLE, 6) AS per_column FROM a""")
def image_layout(spark, sf_dir):
    return op.layout(pixels(spark, sf_dir))


def _following(jump: float, momentum: float) -> str:
    """The trace column by column: state (last height, last step), and the points so far."""
    near = "list_min(list_transform(ys, lambda y: {{'d': abs(y - {aim}), 'y': y}})).y"
    return (
        PIXELS.replace("WITH ", "WITH RECURSIVE ", 1)
        + f""", c AS (SELECT image, x, list(DISTINCT y) AS ys, median(y) AS m FROM px GROUP BY image, x), o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY x) AS k FROM c), h AS (SELECT image, greatest(1, max(y) - min(y) + 1) AS h FROM px GROUP BY image),
t AS (SELECT image, k, x, {near.format(aim="m")}::DOUBLE AS y, true AS ok, {near.format(aim="m")}::DOUBLE AS la, 0.0::DOUBLE AS st FROM o WHERE k = 1 UNION ALL
  SELECT image, k, x, best, ok, CASE WHEN ok THEN best ELSE la END, CASE WHEN ok THEN best - la ELSE st END FROM (
    SELECT *, abs(best - aim) <= {jump} * h AS ok FROM (SELECT o.image, o.k, o.x, h, la, st, la + {momentum} * st AS aim, {near.format(aim=f"(la + {momentum} * st)")}::DOUBLE AS best FROM t JOIN o ON o.image = t.image AND o.k = t.k + 1 JOIN h ON h.image = t.image)))
SELECT image, x, y FROM t WHERE ok"""
    )


@query("image_nearest_trace", _following(0.12, 0.0))
def image_nearest_trace(spark, sf_dir):
    return op.following_trace(pixels(spark, sf_dir))


@query("image_momentum_trace", _following(0.3, 0.5))
def image_momentum_trace(spark, sf_dir):
    return op.following_trace(pixels(spark, sf_dir), 0.3, 0.5)
