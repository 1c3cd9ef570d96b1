"""Motion: bouts, epochs, axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import r6, share
from .events import runs
from .waveform import rolling_rms


def activity_bouts(samples: DataFrame, width: int, least: int, floor: float = 0.06) -> DataFrame:
    """Runs where the rolling RMS of the centred signal exceeds max(median + 2 deviations, floor)."""
    whole = Window.partitionBy("record")
    centred = samples.withColumn("x", F.col("x") - F.median("x").over(whole))
    rows = rolling_rms(centred, width)
    rows = rows.withColumn("thr", F.greatest(F.median("rms").over(whole) + 2 * F.stddev_pop("rms").over(whole), F.lit(floor)))
    return runs(rows, F.col("rms") > F.col("thr"), least)


def epoch_actigraphy(samples: DataFrame, epoch: int) -> DataFrame:
    """Mean deviation from the median in tumbling epochs (the last may be short), and shares of rest to vigorous."""
    rows = samples.withColumn("e", F.abs(F.col("x") - F.median("x").over(Window.partitionBy("record"))))
    each = rows.groupBy("record", F.floor(F.col("idx") / epoch).alias("epoch")).agg(F.avg("e").alias("m"))
    m = F.col("m")
    return each.groupBy("record").agg(
        F.count("*").alias("epochs"), r6(F.avg("m")).alias("mean_enmo"), r6(share(m < 0.03)).alias("rest"), r6(share((m >= 0.03) & (m < 0.05))).alias("sedentary"),
        r6(share((m >= 0.05) & (m < 0.12))).alias("light"), r6(share(m >= 0.12)).alias("mvpa"),
    )


def sleep_wake(samples: DataFrame, epoch: int) -> DataFrame:
    """Sleep or wake by rest share and mean activity."""
    rows = epoch_actigraphy(samples, epoch)
    state = F.when((F.col("rest") >= 0.6) & (F.col("mean_enmo") < 0.05), "sleep").when(F.col("mean_enmo") < 0.1, "quiet_wake").otherwise("active_wake")
    return rows.select("record", "rest", "mean_enmo", state.alias("state"))


def axis_features(axes: DataFrame) -> DataFrame:
    """Magnitude and correlations of three axes (record, x, y, z)."""
    m = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.coalesce(F.col("z") ** 2, F.lit(0.0)))
    return axes.withColumn("m", m).groupBy("record").agg(
        r6(F.avg("m")).alias("mean_magnitude"), r6(F.stddev_pop("m")).alias("sd_magnitude"), r6(F.corr("x", "y")).alias("corr_xy"), r6(F.corr("x", "z")).alias("corr_xz"), r6(F.corr("y", "z")).alias("corr_yz"),
    )
