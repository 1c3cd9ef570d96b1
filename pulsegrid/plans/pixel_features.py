"""Queries on coloured pixels and on patients with several sites; order lines are pixels, orders recordings of customers."""

from ..operators import patients as rollup
from ..operators import pixel_features as op
from ..sources.tables import table
from . import query
from .components import HEIGHT, WIDTH, sizes
from pyspark.sql import functions as F

COLOURS = f"""WITH px AS (SELECT l_suppkey // 5 AS image, l_partkey % {WIDTH} AS x, CASE WHEN l_orderkey % 3 = 0 THEN 8 ELSE 66 END + abs(l_partkey % {WIDTH} % 40 - 20) + l_linenumber AS y,
  max(l_quantity) * 5 / 255.0::DOUBLE AS r, max(l_linenumber) * 30 / 255.0::DOUBLE AS g, max(l_orderkey % 256) / 255.0::DOUBLE AS b FROM lineitem GROUP BY 1, 2, 3),
pg AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS v FROM px),
pn AS (SELECT *, CASE WHEN y - lag(y) OVER c = 1 THEN abs(v - lag(v) OVER c) ELSE 0 END AS gy, CASE WHEN x - lag(x) OVER r = 1 THEN abs(v - lag(v) OVER r) ELSE 0 END AS gx FROM pg
  WINDOW c AS (PARTITION BY image, x ORDER BY y), r AS (PARTITION BY image, y ORDER BY x))
SELECT image, x, y, round(v, 6) AS grey, round(1 - v, 6) AS dark, round(r, 6) AS red, round(g, 6) AS green, round(b, 6) AS blue, round(greatest(r, g, b) - least(r, g, b), 6) AS saturation,
  round(b - greatest(r, g), 6) AS blue_excess, round(r - greatest(g, b), 6) AS red_excess, round(y / {HEIGHT - 1}.0::DOUBLE, 6) AS row, round(x / {WIDTH - 1}.0::DOUBLE, 6) AS col, round(gy, 6) AS grad_y, round(gx, 6) AS grad_x FROM pn"""


@query("image_pixel_features", COLOURS)
def image_pixel_features(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    x = F.col("l_partkey") % WIDTH
    y = F.when(F.col("l_orderkey") % 3 == 0, 8).otherwise(66) + F.abs(x % 40 - 20) + F.col("l_linenumber")
    rows = line.groupBy(F.floor(F.col("l_suppkey") / 5).alias("image"), x.alias("x"), y.alias("y"))
    pixels = rows.agg((F.max("l_quantity") * 5).alias("r"), (F.max("l_linenumber") * 30).alias("g"), F.max(F.col("l_orderkey") % 256).alias("b"))
    return op.pixel_features(pixels, sizes(line.select(F.floor(F.col("l_suppkey") / 5).alias("image"))), 16)


RECORDINGS = """WITH r AS (SELECT o_custkey AS patient, o_orderdate AS d, o_orderkey AS k, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 6 ELSE CAST(left(o_orderpriority, 1) AS INTEGER) END AS place, floor(o_totalprice) % 1000 / 1000.0::DOUBLE AS score FROM orders),
f AS (SELECT *, ['AV', 'PV', 'TV', 'MV', 'Phc'][place] AS site FROM r WHERE place <= 5 QUALIFY row_number() OVER (PARTITION BY patient, place ORDER BY d, k) = 1)"""


def recordings(spark, sf_dir):
    """Each customer with its orders as recordings in order of time; the site follows the priority, and some sites are unknown."""
    orders = table(spark, sf_dir, "orders")
    place = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0), 6).otherwise(F.left("o_orderpriority", F.lit(1)).cast("int"))
    site = F.element_at(F.array(*map(F.lit, (" av", "PV", "tv ", "MV", "PHC", "back"))), place)
    one = F.struct("o_orderdate", "o_orderkey", site.alias("site"), (F.floor("o_totalprice") % 1000 / F.lit(1000.0)).alias("score"))
    return orders.groupBy(F.col("o_custkey").alias("patient")).agg(F.sort_array(F.collect_list(one)).alias("recordings"))  # the orders of one customer


@query("pcg_patient_rollup", RECORDINGS + """, p AS (SELECT patient, list(site ORDER BY place) AS used, count(*) AS n, round(avg(score), 6) AS m, max(score) - min(score) AS s, min(struct_pack(v := -score, p := place, site := site)).site AS top, count(*) FILTER (WHERE score >= 0.5) AS q FROM f GROUP BY patient),
a AS (SELECT i.patient, coalesce(used, []) AS used, coalesce(n, 0) AS n, m, s, top, CASE WHEN n IS NULL THEN 'no_site' WHEN q > 0 AND q < n AND abs(m - 0.5::DOUBLE) < 0.05::DOUBLE THEN 'abstain' WHEN m >= 0.5 THEN 'present' ELSE 'absent' END AS finding
  FROM (SELECT DISTINCT o_custkey AS patient FROM orders) i LEFT JOIN p USING (patient))
SELECT patient, array_to_string(used, ',') AS used, array_to_string([x FOR x IN ['AV', 'PV', 'TV', 'MV', 'Phc'] IF NOT list_contains(used, x)], ',') AS missing, n AS n_sites, m AS mean_score, round(s, 6) AS spread, top AS strongest, finding,
  CASE WHEN n = 0 THEN 0.0 WHEN finding = 'abstain' THEN 0.3 WHEN n >= 3 THEN 0.72 ELSE 0.6 END::DOUBLE AS confidence FROM a""")
def pcg_patient_rollup(spark, sf_dir):
    return rollup.patient_rollup(recordings(spark, sf_dir))


@query("pcg_site_summary", RECORDINGS + " SELECT site, count(*) AS patients, round(avg(score), 6) AS mean_score, round(avg((score >= 0.5)::INT), 6) AS present_share FROM f GROUP BY site")
def pcg_site_summary(spark, sf_dir):
    return rollup.site_summary(recordings(spark, sf_dir))
