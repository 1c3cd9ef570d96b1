"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets within a source, named by three hexadecimal digits.
BUCKET_DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target): capped water-filling over (source, size).

    Sources in code-point order, null last, weigh weights[0], weights[1], ... repeating.
    They share ``share`` times all sizes; a source stops at ``max_epochs`` times its size and
    its excess goes to the others by weight until no target is above its cap.  Sorted by
    cap per weight the capped sources are a prefix, so the level follows from running sums
    over the sources instead of rounds.  A source without words gets 0; where all sources
    are capped the targets are the caps.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everywhere = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", weight)
        .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everywhere))
        .withColumn("below", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("capped", F.col("ratio") * F.col("open") <= F.col("budget") - F.coalesce("below", F.lit(0.0)))
        .withColumn("used", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everywhere))
        .withColumn("free", F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everywhere))
        .withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * (F.col("budget") - F.col("used")) / F.col("free")))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix") -> DataFrame:
    """How often a mix takes each document.

    docs: doc_id, text, source.  Returns one row per input row: doc_id, source, size (words),
    source_size, target (words of its source), copies, taken (= copies * size).  All documents
    of a source are taken floor(target / source_size) times; for the fraction left, documents
    are taken once more in the order of a seeded hash as long as the middle of the document
    lies within it, so a source misses its target by half a document at most.

    Null texts and texts without words have size 0 (they get the whole copies only); null
    sources are one source; a null doc_id hashes as the word null; rows that repeat are
    separate documents; an empty table gives an empty result.

    A hot source is dealt out by the leading digits of the hash: sums per (source, bucket)
    give each bucket its place, and running sums are made within a bucket only.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.substring(key, 1, 16).alias("h"),
    ).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    sized = materialize(sized, "sized")  # a narrow table, so that texts are read and their words counted once
    target = source_targets(sized, weights, share, max_epochs)
    plan = target.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    ).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    place = sums.withColumn("ahead", F.coalesce(ahead, F.lit(0))).drop("in_bucket")
    place = place.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    place = place.withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    before = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    out = sized.withColumn("before", F.coalesce(before, F.lit(0))).join(place, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    extra = (F.col("part") > 0) & (F.col("ahead") + F.col("before") + F.col("size") / 2 <= F.col("part"))
    return out.withColumn("copies", F.col("whole") + extra.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, ...), each as often as ``mixed`` takes its doc_id; null ids are one document.

    Rows of one doc_id are the same document.  Null and empty texts have size 0 and are taken in
    whole copies only, so where a source is taken less than once they go.  Other columns, whatever
    their names, are returned as they are; an empty table gives an empty result.
    """
    key, copies, copy = fresh(docs.columns, "key", "copies", "copy")
    times = mixed.groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").cast("int").alias(copies)).where(F.col(copies) > 0)
    rows = docs.join(times, docs["doc_id"].eqNullSafe(F.col(key)))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
