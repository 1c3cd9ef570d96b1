"""Scales of images: order lines are pixels of upright and level grid lines and of a trace."""

from ..operators import image_scale as op
from ..sources.tables import table
from . import query
from .kernels import signals
from pyspark.sql import functions as F

WIDTH, HEIGHT = 200, 130

PIXELS = f"""WITH li AS (SELECT l_suppkey // 5 AS image, l_orderkey // 8 AS o, l_orderkey % 8 % 4 AS k, l_partkey AS p, l_linenumber AS ln FROM lineitem),
px AS (SELECT image, CASE WHEN k < 2 THEN (p % 8) * 25 + 3 ELSE (o * 7 + ln * 31) % {WIDTH} END AS x, CASE WHEN k < 2 THEN (o * 11 + ln * 17) % {HEIGHT} WHEN k = 2 THEN (p % 5) * 28 + 5 ELSE 58 + p % 17 END AS y, CASE WHEN k < 2 THEN 200 WHEN k = 2 THEN 212 ELSE 30 END + ln AS grey FROM li),
ax AS (SELECT DISTINCT * FROM (SELECT image, 'x' AS axis, x AS pos, y AS along, {WIDTH} AS across, {HEIGHT} AS len FROM px WHERE grey < 220 UNION ALL SELECT image, 'y', y, x, {HEIGHT}, {WIDTH} FROM px WHERE grey < 220)),
sn AS (SELECT *, CASE WHEN along - lag(along) OVER w <= 7 THEN 0 ELSE 1 END AS new FROM ax WINDOW w AS (PARTITION BY image, axis, pos ORDER BY along)),
st AS (SELECT *, sum(new) OVER (PARTITION BY image, axis, pos ORDER BY along) AS stroke FROM sn),
mk AS (SELECT image, axis, pos, across, len, sum(n) / len::DOUBLE AS density, max(span) AS span FROM (SELECT image, axis, pos, across, len, stroke, count(*) AS n, max(along) - min(along) AS span FROM st GROUP BY ALL) GROUP BY image, axis, pos, across, len),
lv AS (SELECT image, axis, quantile_cont(d, 0.99) AS level FROM (SELECT g.image, g.axis, coalesce(density, 0) AS d FROM (SELECT image, axis, unnest(range(0, any_value(across))) AS pos FROM mk GROUP BY image, axis) g LEFT JOIN mk USING (image, axis, pos)) GROUP BY 1, 2),
ru AS (SELECT mk.*, CASE WHEN pos - lag(pos) OVER w <= greatest(2.5, across * CASE axis WHEN 'x' THEN 0.003 ELSE 0.005 END) THEN 0 ELSE 1 END AS new FROM mk JOIN lv USING (image, axis) WHERE span >= greatest(80, 0.65 * len) OR density > greatest(0.45, level) WINDOW w AS (PARTITION BY image, axis ORDER BY pos)),
ls AS (SELECT image, axis, line::BIGINT AS line, round(avg(pos), 6) AS centre, max(pos) - min(pos) + 1 AS thickness FROM (SELECT *, sum(new) OVER (PARTITION BY image, axis ORDER BY pos) AS line FROM ru) GROUP BY 1, 2, 3)"""


def pixels(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    o, k, p, n = F.floor(F.col("l_orderkey") / 8), F.col("l_orderkey") % 8 % 4, F.col("l_partkey"), F.col("l_linenumber")
    x = F.when(k < 2, p % 8 * 25 + 3).otherwise((o * 7 + n * 31) % WIDTH)
    y = F.when(k < 2, (o * 11 + n * 17) % HEIGHT).when(k == 2, p % 5 * 28 + 5).otherwise(58 + p % 17)
    return line.select(F.floor(F.col("l_suppkey") / 5).alias("image"), x.alias("x"), y.alias("y"), (F.when(k < 2, 200).when(k == 2, 212).otherwise(30) + n).alias("grey"))


def sizes(rows):
    return rows.select("image").distinct().select("image", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


@query("image_ruled_lines", PIXELS + " SELECT * FROM ls")
def image_ruled_lines(spark, sf_dir):
    rows = pixels(spark, sf_dir)
    return op.ruled_lines(rows, sizes(rows))


@query("image_axis_scale", PIXELS + """, bx AS (SELECT image, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM px WHERE grey < 245 GROUP BY image),
sp AS (SELECT image, count(*) FILTER (WHERE axis = 'x') AS lines_x, count(*) FILTER (WHERE axis = 'y') AS lines_y, round(median(step) FILTER (WHERE axis = 'x' AND step > 4), 6) AS spacing_x, round(median(step) FILTER (WHERE axis = 'y' AND step > 4), 6) AS spacing_y
  FROM (SELECT *, centre - lag(centre) OVER (PARTITION BY image, axis ORDER BY centre) AS step FROM ls) GROUP BY image),
du AS (SELECT bx.*, coalesce(lines_x, 0) AS lines_x, coalesce(lines_y, 0) AS lines_y, spacing_x, spacing_y, (x_max - x_min + 1) / spacing_x * 0.2::DOUBLE AS d, (y_max - y_min + 1) / spacing_y * 0.5::DOUBLE AS v FROM bx LEFT JOIN sp USING (image))
SELECT * EXCLUDE (d, v), round(d, 6) AS duration_s, round((x_max - x_min + 1) / d, 6) AS rate_hz, round(v, 6) AS value_span, concat_ws(',', CASE WHEN d IS NULL THEN 'duration' END, CASE WHEN v IS NULL THEN 'value_per_grid' END) AS missing,
  round(least(0.95::DOUBLE, 0.25::DOUBLE + CASE WHEN spacing_x IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN spacing_y IS NULL THEN 0 ELSE 0.35::DOUBLE END), 6) AS confidence FROM du""")
def image_axis_scale(spark, sf_dir):
    rows = pixels(spark, sf_dir)
    return op.axis_scale(rows, sizes(rows), seconds_per_grid=0.2, value_per_grid=0.5)


@query("image_comb_spacing")
def image_comb_spacing(spark, sf_dir):
    rows = pixels(spark, sf_dir)
    return op.comb_spacing(op.profiles(rows, sizes(rows)))


@query("image_duration_choice")
def image_duration_choice(spark, sf_dir):
    return op.choose_duration(signals(spark, sf_dir), [(10.0, 0.5), (5.0, 0.3), (20.0, None)], "ppg")
