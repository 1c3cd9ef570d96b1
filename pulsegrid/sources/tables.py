"""Signals out of stored tables.

The operators work on logical tables: samples (record, idx, x), beats (record, idx, t, x, kind)
and so on.  These adapters make them from event and vector tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import r6

#: Microseconds of event time that make a second of signal: events come about every eight hours, beats about every second.
MICROS_PER_SECOND = 28_800_000_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp, with or without time zone."""
    return F.expr(f"unix_micros(CAST({ts} AS TIMESTAMP)) - unix_micros(CAST(TIMESTAMP_NTZ '1970-01-01 00:00:00' AS TIMESTAMP))")


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in order, as beats of a record: record, idx, t (signal seconds), x, kind."""
    order = Window.partitionBy("record").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("record"), "ts", "event_id", F.col("value").alias("x"), F.col("event_type").alias("kind"))
    return rows.select("record", F.row_number().over(order).cast("long").alias("idx"), (micros() / F.lit(MICROS_PER_SECOND)).alias("t"), "x", "kind")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as uniformly sampled signals: record, idx from 0, x."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record"), F.posexplode("embedding").alias("idx", "x")).withColumns({"idx": F.col("idx").cast("long"), "x": F.col("x").cast("double")})


def oximetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as saturation readings: record, idx, spo2, higher values reading lower."""
    return beats(spark, sf_dir).select("record", "idx", r6(F.lit(100.0) - F.least(F.col("x") / 8, F.lit(49.0))).alias("spo2"))


#: The same tables in SQL.
BEATS_SQL = """beats AS (SELECT user_id AS record, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx,
  CAST(epoch_us(ts) AS DOUBLE) / 28800000000.0::DOUBLE AS t, value AS x, event_type AS kind FROM events)"""
SAMPLES_SQL = """samples AS (SELECT vec_id AS record, i - 1 AS idx, CAST(embedding[i] AS DOUBLE) AS x
  FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"""
OXIMETRY_SQL = BEATS_SQL + """, oximetry AS (SELECT record, idx, round(100.0::DOUBLE - least(x / 8, 49.0::DOUBLE), 6) AS spo2 FROM beats)"""
