"""Signals out of files: delimited text, WAV, EDF, manifests.  All listing and reading is Spark's."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNAL = "path string, channel string, rate double, values array<double>"
#: Names that stand for the axes of a motion sensor.
AXES = {a: (a, f"acc_{a}", f"accel_{a}", f"total_acc_{a}") for a in "xyz"}


def value_column(schema: T.StructType, column: str | None = None) -> str:
    """The column asked for, else ``signal``, else the first numeric one."""
    names = schema.fieldNames()
    if column is not None:
        if column not in names:
            raise ValueError(f"no column {column}; there are {', '.join(names)}")
        return column
    if "signal" in names:
        return "signal"
    for f in schema.fields:
        if isinstance(f.dataType, T.NumericType):
            return f.name
    raise ValueError("no numeric column")


def axis_columns(schema: T.StructType) -> dict[str, str]:
    """The columns of the three axes by their usual names, else the first three numeric ones."""
    lower = {f.name.lower(): f.name for f in schema.fields}
    found = {a: next((lower[n] for n in names if n in lower), None) for a, names in AXES.items()}
    if None in found.values():
        numeric = [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)][:3]
        if len(numeric) < 3:
            raise ValueError("three axes are needed")
        found = dict(zip("xyz", numeric, strict=True))
    return found


def read_delimited(spark: SparkSession, path: str, column: str | None = None, sep: str = ",", schema: str | None = None) -> DataFrame:
    """Samples (record, idx, x) of delimited files, the file name as record.

    Values that are missing or not finite go before samples are numbered from 0.  Lines of a
    file keep their order; a file is one record, so give a schema in production: without one,
    Spark reads the files twice.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    rows = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    x = F.col(value_column(rows.schema, column)).try_cast("double")
    rows = rows.select(F.input_file_name().alias("record"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), x.alias("x"))
    rows = rows.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    order = Window.partitionBy("record").orderBy("_block", "_at")
    return rows.select("record", (F.row_number().over(order) - 1).cast("long").alias("idx"), "x")


def read_decimal_comma(spark: SparkSession, path: str) -> DataFrame:
    """Rows of numbers (record, values) in text files split by white space, with a comma or point before decimals."""
    parts = F.split(F.trim(F.replace("value", F.lit(","), F.lit("."))), r"\s+")
    rows = spark.read.text(path).select(F.input_file_name().alias("record"), F.transform(parts, lambda p: p.try_cast("double")).alias("values"))
    return rows.where(F.forall("values", lambda v: v.isNotNull()))


def _binary(spark: SparkSession, path: str, parse) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *r) for p, content in zip(pdf["path"], pdf["content"], strict=True) for r in parse(content)]
            yield pd.DataFrame(rows, columns=["path", "channel", "rate", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SIGNAL)


def parse_wav(content: bytes) -> list[tuple[str, float, list[float]]]:
    """Channels of a RIFF file of 8, 16, 24 or 32-bit integers or 32-bit floats, integers scaled to -1 .. 1."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, b""
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", content[at + 8 : at + 24])
        elif name == b"data":
            data = content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None:
        raise ValueError("no format chunk")
    kind, channels, rate, _, _, bits = form
    if kind == 3 and bits == 32:
        x = np.frombuffer(data, "<f4").astype(float)
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(data, f"<i{bits // 8}").astype(float) / float(1 << (bits - 1))
    x = x[: len(x) // channels * channels].reshape(-1, channels)
    return [(str(k), float(rate), x[:, k].tolist()) for k in range(channels)]


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """One row for each channel of each WAV file: path, channel, rate, values."""
    return _binary(spark, path, parse_wav)


def parse_edf(content: bytes) -> list[tuple[str, float, list[float]]]:
    """Channels of a European Data Format file in physical units."""
    f = io.BytesIO(content)
    f.read(184)
    f.read(8 + 44)
    records, seconds, n = int(f.read(8)), float(f.read(8)), int(f.read(4))
    column = lambda width: [f.read(width).decode("latin-1").strip() for _ in range(n)]
    labels = column(16)
    column(80), column(8)
    p0, p1, d0, d1 = ([float(v) for v in column(8)] for _ in range(4))
    column(80)
    counts = [int(v) for v in column(8)]
    column(32)
    raw = np.frombuffer(f.read(), "<i2")
    records = records if records >= 0 else len(raw) // sum(counts)
    raw = raw[: records * sum(counts)].reshape(records, sum(counts))
    out, at = [], 0
    for k in range(n):
        x = raw[:, at : at + counts[k]].reshape(-1).astype(float)
        at += counts[k]
        gain = (p1[k] - p0[k]) / (d1[k] - d0[k]) if d1[k] != d0[k] else 1.0
        out.append((labels[k], counts[k] / seconds if seconds else 0.0, (p0[k] + (x - d0[k]) * gain).tolist()))
    return out


def read_edf(spark: SparkSession, path: str) -> DataFrame:
    """One row for each channel of each EDF file: path, channel, rate, values."""
    return _binary(spark, path, parse_edf)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of dataset manifests, JSON files {dataset, records: [...]}, with the dataset's name on each."""
    whole = spark.read.option("multiLine", True).schema(f"dataset string, records array<struct<{schema}>>").json(path)
    rows = whole.select("dataset", F.explode("records").alias("r"))
    return rows.select("r.*", "dataset") if "dataset" not in rows.schema["r"].dataType.fieldNames() else rows.select("r.*")


def valid_inputs(rows: DataFrame, modalities: list[str]) -> DataFrame:
    """Signal descriptions (modality, path, sampling_rate) with a reason where they are not valid, else null."""
    known = F.lower("modality").isin(modalities)
    reason = F.when(~F.coalesce(known, F.lit(False)), "unknown modality").when(~F.coalesce(F.col("sampling_rate") > 0, F.lit(False)), "sampling rate must be positive")
    return rows.withColumn("modality", F.lower("modality")).withColumn("reason", reason.when(F.coalesce(F.trim("path"), F.lit("")) == "", "no path"))


def write_traces(traces: DataFrame, path: str) -> None:
    """Traces as JSON lines by day, each with an id of its own."""
    now = F.current_timestamp()
    named = traces.withColumn("created_at", now).withColumn("trace_id", F.concat(F.date_format(now, "yyyyMMdd'T'HHmmss"), F.lit("_"), F.substring(F.uuid(), 1, 8)))
    named.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").json(path)


def write_delimited(rows: DataFrame, path: str, sep: str = ",") -> None:
    """Writes rows as delimited files with a header; arrays and structs as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in rows.schema]
    rows.select(*flat).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
