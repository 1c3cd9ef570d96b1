"""Oxygen saturation: summaries, burden, baselines, desaturation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ladder, r6, share
from .events import runs


def _order() -> Window:
    return Window.partitionBy("record").orderBy("idx")


def summary(spo2: DataFrame) -> DataFrame:
    """Mean, median, nadir, and shares of time below 90, 88 and 85."""
    return spo2.groupBy("record").agg(
        F.count("*").alias("n"), r6(F.avg("spo2")).alias("mean_spo2"), r6(F.median("spo2")).alias("median_spo2"), r6(F.min("spo2")).alias("nadir"),
        r6(share(F.col("spo2") < 90)).alias("t90"), r6(share(F.col("spo2") < 88)).alias("t88"), r6(share(F.col("spo2") < 85)).alias("t85"),
    )


def hypoxemia_burden(spo2: DataFrame, rate: float = 1.0) -> DataFrame:
    """The area below 90 in percent-minutes an hour (trapezoids), and the level of burden."""
    depth = F.greatest(F.lit(0.0), 90 - F.col("spo2"))
    rows = spo2.withColumn("d", depth).withColumn("next", F.lead("d").over(_order()))
    area = rows.groupBy("record").agg(F.coalesce(F.sum((F.col("d") + F.col("next")) / 2), F.lit(0.0)).alias("a"), F.count("*").alias("c"))
    hours = F.col("c") / rate / 3600
    area = area.select("record", r6(F.col("a") / rate / 60 / hours).alias("area_per_hour"))
    high = (F.col("t88") > 0.05) | (F.col("nadir") < 85) | (F.col("area_per_hour") > 5)
    level = F.when(high, "high").when((F.col("t90") > 0.05) | (F.col("area_per_hour") > 1), "moderate").otherwise("low")
    return summary(spo2).join(area, "record").select("record", "nadir", "t90", "t88", "area_per_hour", level.alias("burden"))


def rolling_baseline(spo2: DataFrame, width: int) -> DataFrame:
    """The 90th percentile of the last width + 1 readings; in a record of no more than ``width``, the highest so far (at most 100)."""
    long = F.percentile("spo2", F.lit(0.9)).over(_order().rowsBetween(-width, 0))
    short = F.max(F.least("spo2", F.lit(100.0))).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    rows = spo2.withColumns({"n": F.count("*").over(Window.partitionBy("record")), "long": long, "short": short})
    return rows.select("record", "idx", "spo2", r6(F.when(F.col("n") <= width, F.col("short")).otherwise(F.col("long"))).alias("baseline"))


def odi_severity(spo2: DataFrame, drop: float, width: int, least: int, rate: float = 1.0) -> DataFrame:
    """Runs below baseline - drop, an hour, and the severity by 5, 15 and 30."""
    base = rolling_baseline(spo2, width)
    events = runs(base, F.col("spo2") < F.col("baseline") - drop, least).groupBy("record").agg(F.count("*").alias("events"))
    out = spo2.groupBy("record").agg(F.count("*").alias("n")).join(events, "record", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    odi = r6(F.col("events") / (F.col("n") / rate / 3600))
    return out.select("record", "events", odi.alias("odi"), ladder(odi, [(30, "severe"), (15, "moderate"), (5, "mild")], "normal").alias("severity"))


def apnea_risk(spo2: DataFrame, width: int) -> DataFrame:
    """A bounded score from two desaturation indices and the time below 90."""
    odi = lambda drop: odi_severity(spo2, drop, width, 1).select("record", F.col("odi").alias(f"odi{int(drop)}"))
    rows = odi(3.0).join(odi(4.0), "record").join(summary(spo2).select("record", "t90"), "record")
    one = F.lit(1.0)
    score = F.least(F.col("odi3") / 30, one) * 0.55 + F.least(F.col("odi4") / 20, one) * 0.25 + F.least(F.col("t90") / 0.15, one) * 0.20
    return rows.select("record", r6(score).alias("score"), ladder(r6(score), [(0.7, "high"), (0.4, "moderate")], "low").alias("risk"))


class DropScan:
    """Desaturations of one record, reading by reading; what it keeps does not grow with the record or the event.

    An event starts with a reading below baseline - drop and lasts to its last such reading.  It is over
    once a reading is within 1 of the baseline at its start, or no low one came for
    ``gap`` seconds.  Readings since the last low one wait, since they count only if another follows.
    """

    def __init__(self, drop: float, least: int, gap: int, rate: float) -> None:
        self.drop, self.least, self.gap, self.rate = drop, least, gap, rate
        self.start = self.last = -1
        self.base = self.nadir = self.area = self.before = 0.0
        self.waiting: list[float] = []

    def _count(self, x: float) -> None:
        under = max(0.0, self.base - x)
        self.area += (self.before + under) / 2
        self.before, self.nadir = under, min(self.nadir, x)

    def feed(self, i: int, x: float, base: float) -> tuple | None:
        """Takes reading i; returns the event that it ends."""
        if x < base - self.drop:
            if self.start < 0:
                self.start, self.base, self.nadir, self.area, self.before = i, base, x, 0.0, max(0.0, base - x)
            else:
                for w in (*self.waiting, x):
                    self._count(w)
            self.last = i
            self.waiting.clear()
        elif self.start >= 0:
            if x >= self.base - 1 or (i - self.last) / self.rate > self.gap:
                return self.close()
            self.waiting.append(x)
        return None

    def event(self) -> tuple | None:
        """The open event as far as it goes: start, end, seconds, depth, nadir, area."""
        n = self.last - self.start + 1
        if self.start < 0 or n < self.least:
            return None
        return self.start, self.last + 1, n / self.rate, round(self.base - self.nadir, 6), self.nadir, round(self.area / self.rate, 6)

    def close(self) -> tuple | None:
        out = self.event()
        self.start = -1
        self.waiting.clear()
        return out


def desaturations(spo2: DataFrame, drop: float, width: int, least: int, gap: int = 3, rate: float = 1.0) -> DataFrame:
    """Desaturation events with recovery: from the first reading below baseline - drop until recovery to
    within 1 of the baseline at the start, or until no such reading came for ``gap`` seconds.

    The window of the baseline leaves the readings of a record side by side and in order, so they stream through one
    ``DropScan`` a record: no group is gathered, and nothing is shuffled again.
    """
    names = ("record", "start", "end", "duration_s", "depth", "nadir", "area")
    schema = pa.schema([*((n, pa.int64()) for n in names[:3]), *((n, pa.float64()) for n in names[3:])])

    def run(batches):
        record, scan, i = None, None, -1
        for b in batches:
            out = []
            for r, x, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if scan is None or r != record:
                    if scan and (e := scan.close()):
                        out.append((record, *e))
                    record, scan, i = r, DropScan(drop, least, gap, rate), -1
                i += 1
                if x is not None and base is not None and (e := scan.feed(i, x, base)):
                    out.append((record, *e))
            yield pa.RecordBatch.from_pylist([dict(zip(names, e, strict=True)) for e in out], schema)
        if scan and (e := scan.close()):
            yield pa.RecordBatch.from_pylist([dict(zip(names, (record, *e), strict=True))], schema)

    rows = rolling_baseline(spo2, width).sortWithinPartitions("record", "idx").select(F.col("record").cast("long"), "spo2", "baseline")
    return rows.mapInArrow(run, "record long, start long, end long, duration_s double, depth double, nadir double, area double")
