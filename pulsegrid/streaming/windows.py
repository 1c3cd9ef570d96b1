"""Epochs and sessions over event time, the same for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.columns import r6
from ..sources.scratch import shared_path
from ..sources.tables import micros, table


def _timed(rows: DataFrame) -> DataFrame:
    """Event time as a timestamp with zone, which watermarks need; microseconds stay as stored."""
    return rows.select("user_id", "event_type", "value", F.timestamp_micros(micros()).alias("ts"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str, schema: StructType | None = None) -> DataFrame:
    """The events table as a stream: files that are there, then files that come.  The schema is that of the table unless given."""
    schema = schema or table(spark, sf_dir, "events").schema
    return _timed(spark.readStream.schema(schema).parquet(sf_dir if sf_dir.endswith("*") else f"{sf_dir}/events.parquet*"))


def sessions(rows: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user that end ``gap`` after their last event."""
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def epochs(rows: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts and mean value in tumbling epochs by kind of event."""
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"))
    return out.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "mean_value")


def run_available(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs an aggregating stream over what is there and returns its rows, as a table in the shared folder.

    In update mode each batch gives the rows it changed, open windows included; the last row of each
    key (``keys``) counts.  A batch that is run again writes the same place.
    """
    spark = stream.sparkSession
    path = shared_path(spark, "stream")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/out")
    last = F.max_by(F.struct(*stream.columns), "batch").alias("row")
    return rows.groupBy(*keys).agg(last).select("row.*")
