"""Helpers shared by the training-data operators: scratch tables, Arrow batches, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once.  Documents can be long, so far fewer than Spark's default.
ARROW_ROWS = 256
#: Bytes handed over at once; a row that is longer goes alone.
ARROW_BYTES = 8 << 20


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keeps Arrow batches small enough for long texts, by rows and by bytes (session settings of Spark).

    Also lets Python workers find this package where it is on the driver's path only.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), root)))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Only a local session may do without it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pulsegrid-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one folder for each application."""
    return f"{shared_dir(spark)}/pulsegrid-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    This cuts the lineage and survives lost executors.  Results may still be read from such
    a table after the operator has returned, so the tables stay until ``clear_scratch``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables that operators of this application have written to the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pulsegrid-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Names that clash with none of ``taken``, whatever the case of letters."""
    low = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components by alternating large and small stars.

    edges: two long columns a, b.  Returns (id, component) for every id on an edge, component
    the smallest id reachable.  No neighbour list is ever gathered: a hub only meets
    aggregates, which combine before the shuffle, and joins that AQE can split.
    An empty table of edges gives an empty result; loops and repeated edges do no harm.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == seen or not mark["n"]:
            break
        seen = (mark["n"], mark["h"])
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        cur = materialize(small, "edges")
    else:
        raise RuntimeError("connected components did not settle")
    return cur.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionByName(
        cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
