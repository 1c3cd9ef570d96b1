"""Queries over connected pixels; order lines are pixels of images with two rising and falling traces."""

from ..operators import components as op
from ..sources.tables import table
from . import query
from pyspark.sql import functions as F

WIDTH, HEIGHT = 120, 110
MARKS = f"""WITH RECURSIVE px AS (SELECT DISTINCT l_suppkey // 5 AS image, l_partkey % {WIDTH} AS x,
  CASE WHEN l_orderkey % 3 = 0 THEN 8 ELSE 66 END + abs(l_partkey % {WIDTH} % 40 - 20) + l_linenumber AS y FROM lineitem WHERE (l_partkey + l_suppkey) % 7 > 0),
st AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY image, y ORDER BY x) = 1 THEN NULL ELSE x END AS s FROM px),
pn AS (SELECT image, x, y, last_value(s IGNORE NULLS) OVER (PARTITION BY image, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS s FROM st),
ed AS (SELECT DISTINCT a.image, a.y * 1000 + a.s AS a, b.y * 1000 + b.s AS b FROM pn a JOIN pn b ON a.image = b.image AND a.x = b.x AND b.y = a.y + 1),
es AS (SELECT * FROM ed UNION ALL SELECT image, b, a FROM ed),
lb AS (SELECT DISTINCT image, y * 1000 + s AS node, y * 1000 + s AS label FROM pn UNION SELECT lb.image, es.b, lb.label FROM lb JOIN es ON es.image = lb.image AND es.a = lb.node WHERE lb.label < es.b),
pt AS (SELECT image, node, min(label) AS part FROM lb GROUP BY image, node),
rn AS (SELECT pn.image, pn.y, min(x) AS x0, max(x) + 1 AS x1, count(*) AS n, any_value(part) AS part FROM pn JOIN pt ON pt.image = pn.image AND pt.node = pn.y * 1000 + pn.s GROUP BY pn.image, pn.y, pn.s),
cp AS (SELECT image, part, min(x0) AS x_min, max(x1) AS x_max, min(y) AS y_min, max(y) + 1 AS y_max, sum(n)::BIGINT AS pixels, sum(n * y)::BIGINT AS s1, sum(n * y * y)::BIGINT AS s2 FROM rn GROUP BY image, part),
co AS (SELECT *, s1 / pixels AS yc, sqrt((pixels * s2 - s1 * s1)::DOUBLE) / pixels AS sd FROM cp)"""
AREA = f"""{MARKS}, ok AS (SELECT *, (x_max - x_min) * sqrt(pixels) * greatest(1, sd) / greatest(1, sqrt(y_max - y_min)) AS score FROM co WHERE pixels >= 12 AND x_max - x_min >= 30 AND sd >= 1.5),
ch AS (SELECT image, greatest(0, y_min - 8) AS t, least({HEIGHT}, y_max + 8) AS b FROM (SELECT *, max(score) OVER (PARTITION BY image) AS top FROM ok)
  QUALIFY row_number() OVER (PARTITION BY image ORDER BY score >= 0.25 * top DESC, yc DESC, score DESC, y_min, x_min) = 1),
me AS (SELECT ok.image, count(*) AS candidates, count(*) FILTER (WHERE sm) AS merged, min(x_min) FILTER (WHERE sm) AS x_min, max(x_max) FILTER (WHERE sm) AS x_max, min(y_min) FILTER (WHERE sm) AS y_min, max(y_max) FILTER (WHERE sm) AS y_max, sum(pixels) FILTER (WHERE sm) AS own
  FROM (SELECT ok.*, yc BETWEEN t AND b OR greatest(0, least(b, y_max) - greatest(t, y_min)) >= greatest(3, floor(0.15::DOUBLE * (y_max - y_min) + 1e-9::DOUBLE)) AS sm FROM ok JOIN ch USING (image)) ok GROUP BY ok.image),
wi AS (SELECT DISTINCT image, unnest(generate_series(greatest(0, y - 2), least({HEIGHT - 1}, y + 2))) AS y FROM (SELECT image, y FROM rn WHERE image NOT IN (SELECT image FROM me) GROUP BY 1, 2 HAVING sum(n) >= 2)),
bn AS (SELECT *, y - row_number() OVER (PARTITION BY image ORDER BY y) AS band FROM wi), be AS (SELECT image, band, min(y) AS y_min, max(y) + 1 AS y_max FROM bn GROUP BY 1, 2),
bf AS (SELECT rn.image, band, min(x0) AS x_min, max(x1) AS x_max, sum(n) AS pixels FROM rn JOIN bn USING (image, y) GROUP BY 1, 2),
bo AS (SELECT *, (x_max - x_min) * sqrt(pixels) / greatest(1, sqrt(y_max - y_min)) AS score FROM bf JOIN be USING (image, band) WHERE y_max - y_min >= 3 AND pixels >= 10 AND x_max - x_min >= 20),
bc AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY image) AS top, count(*) OVER (PARTITION BY image) AS candidates FROM bo)
  QUALIFY row_number() OVER (PARTITION BY image ORDER BY score >= 0.35 * top DESC, y_min + y_max DESC, score DESC, y_min, x_min) = 1),
fo AS (SELECT image, 'components' AS mode, candidates, merged, x_min, x_max, y_min, y_max, own FROM me UNION ALL SELECT image, 'row_band', candidates, 1, x_min, x_max, y_min, y_max, NULL FROM bc),
fa AS (SELECT * FROM fo UNION ALL SELECT image, 'all', 0, 0, min(x0), max(x1), min(y), max(y) + 1, NULL FROM rn WHERE image NOT IN (SELECT image FROM fo) GROUP BY image),
pd AS (SELECT * REPLACE (greatest(0, x_min - 4) AS x_min, least({WIDTH}, x_max + 4) AS x_max, greatest(0, y_min - 4) AS y_min, least({HEIGHT}, y_max + 4) AS y_max) FROM fa),
ct AS (SELECT image, count(*) AS marked, count(*) FILTER (WHERE x >= x_min AND x < x_max AND y >= y_min AND y < y_max) AS inside FROM px JOIN pd USING (image) GROUP BY image)
SELECT image, mode, candidates, merged, x_min, x_max, y_min, y_max, round(marked / {WIDTH * HEIGHT}.0::DOUBLE, 6) AS marked_share, round(coalesce(own, inside) / {WIDTH * HEIGHT}.0::DOUBLE, 6) AS selected_share,
  round((x_max - x_min) * (y_max - y_min) / {WIDTH * HEIGHT}.0::DOUBLE, 6) AS area_share FROM pd JOIN ct USING (image)"""


def marks(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where("(l_partkey + l_suppkey) % 7 > 0")  # a pixel here and there is missing
    x = F.col("l_partkey") % WIDTH
    y = F.when(F.col("l_orderkey") % 3 == 0, 8).otherwise(66) + F.abs(x % 40 - 20) + F.col("l_linenumber")
    return line.select(F.floor(F.col("l_suppkey") / 5).alias("image"), x.alias("x"), y.alias("y"))


def sizes(pixels):
    return pixels.select("image").distinct().select("image", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


@query("image_components", MARKS + " SELECT image, part % 1000 AS first_x, part // 1000 AS first_y, x_min, x_max, y_min, y_max, pixels, round(yc, 6) AS y_center, round(sd, 6) AS vertical_std FROM co")
def image_components(spark, sf_dir):
    return op.components(marks(spark, sf_dir))


@query("image_waveform_area", AREA)
def image_waveform_area(spark, sf_dir):
    pixels = marks(spark, sf_dir)
    return op.waveform_area(pixels, sizes(pixels))


@query("image_waveform_areas")
def image_waveform_areas(spark, sf_dir):
    pixels = marks(spark, sf_dir)
    return op.waveform_areas(pixels, sizes(pixels))
