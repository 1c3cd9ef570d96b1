"""Results to sentences, training rows and fused risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flags, r6, ratio, tenths


def training_rows(turns: DataFrame) -> DataFrame:
    """Chat samples out of traces (trace, turn, role, text): planning and report rows for each answer, use rows where there was a system turn."""
    known = turns.groupBy("trace").agg(F.max((F.col("role") == "system").cast("int")).alias("has_system"))
    answers = turns.where("role = 'assistant'").join(known, "trace")
    tasks = F.array_compact(F.array(F.lit("planning"), F.when(F.col("has_system") == 1, "tool_use"), F.when(F.length("text") > 600, "report")))
    return answers.select("trace", "turn", F.explode(tasks).alias("task"), F.length("text").alias("chars"))


def sentences(rows: DataFrame) -> DataFrame:
    """A line of text for each record (record, n, mean_hr_bpm, rmssd_ms, risk): the first form whose figures are there."""
    rows = rows.withColumns({c: tenths(c) for c in ("mean_hr_bpm", "rmssd_ms")})
    text = (
        F.when(F.col("rmssd_ms").isNotNull(), F.format_string("Record %d: %d intervals, mean rate %.1f bpm, RMSSD %.1f ms, %s risk.", "record", "n", "mean_hr_bpm", "rmssd_ms", "risk"))
        .when(F.col("mean_hr_bpm").isNotNull(), F.format_string("Record %d: mean rate %.1f bpm.", "record", "mean_hr_bpm"))
        .otherwise(F.format_string("Record %d: no result.", "record"))
    )
    return rows.select("record", text.alias("report"))


def weighted_fusion(parts: DataFrame, weights: dict[str, float], steps: tuple[float, float, float] = (0.65, 0.45, 0.25)) -> DataFrame:
    """The weighted mean of the evidence there is (record and a column for each weight), in four levels."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        there = F.col(name).isNotNull() & ~F.isnan(name)
        total = total + F.when(there, F.col(name) * w).otherwise(0.0)
        weight = weight + F.when(there, w).otherwise(0.0)
    score = r6(ratio(total, weight))
    level = F.when(weight == 0, "unknown").when(score >= steps[0], "high").when(score >= steps[1], "moderate").when(score >= steps[2], "mild").otherwise("low")
    return parts.select("record", score.alias("score"), level.alias("level"))


def session_fusion(sessions: DataFrame, **results: tuple[DataFrame, Column, str]) -> DataFrame:
    """Flags from results of several signals (each: table by record, test, name of the flag) left-joined to sessions, and a risk by their number."""
    out = sessions.select("record")
    for key, (rows, test, _) in results.items():
        out = out.join(rows.select("record", test.alias(f"_{key}")), "record", "left")
    found = flags(*[(F.coalesce(F.col(f"_{key}"), F.lit(False)), name) for key, (_, _, name) in results.items()])
    return out.select("record", F.array_join(found, ",").alias("flags"), F.when(F.size(found) >= 2, "elevated").when(F.size(found) == 1, "possible").otherwise("low").alias("risk"))


def json_object(text: Column) -> Column:
    """The JSON object in a text: within a fence, else from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
