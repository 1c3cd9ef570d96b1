"""Windows over three axes; 48 vectors in a row are the axes of a record, its electrocardiogram is the one with laid beats."""

from ..operators import multi_axis as op
from ..sources.tables import table
from . import query
from .beat_detection import ECG_RATE, electrocardiograms
from pyspark.sql import functions as F


def records(spark, sf_dir):
    """record, lat, hf, dv (16 vectors each, in order), ecg of the same number."""
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    place = F.floor(F.col("vec_id") / 16) % 3
    parts = rows.select(F.floor(F.col("vec_id") / 48).alias("record"), place.alias("axis"), F.struct("vec_id", "embedding").alias("part"))
    axis = lambda k: F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("axis") == k, F.col("part")))), lambda p: p["embedding"]))
    axes = parts.groupBy("record").agg(*[axis(k).alias(a) for k, a in enumerate(op.AXES)])  # 48 vectors a record
    return axes.join(electrocardiograms(spark, sf_dir).select("record", F.col("values").alias("ecg")), "record", "left")


@query("scg_axis_windows")
def scg_axis_windows(spark, sf_dir):
    return op.axis_windows(records(spark, sf_dir), ECG_RATE, 6.0, 2.0)


@query("scg_axis_summary", """WITH n AS (SELECT vec_id // 48 AS record, (vec_id // 16) % 3 AS axis, sum(len(embedding)) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1, 2), m AS (SELECT record, round(min(n) / 1.28::DOUBLE)::BIGINT AS m FROM n GROUP BY record HAVING count(*) = 3 AND min(n) >= 16)
SELECT record, CASE WHEN m < 600 THEN 1 ELSE (m - 600) // 200 + 1 END AS windows FROM m""")
def scg_axis_summary(spark, sf_dir):
    """The windows that each record gives; the other figures of the summary are held by tests."""
    return op.axis_summary(scg_axis_windows(spark, sf_dir)).select("record", "windows")
