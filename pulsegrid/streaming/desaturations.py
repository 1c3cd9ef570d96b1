"""Desaturation events of a stream of readings, with own state and timers; the rule is that of the batch scan."""

from __future__ import annotations

import json
import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.columns import r6
from ..operators.oximetry import DropScan
from ..sources.scratch import shared_path
from ..sources.tables import micros, table

EVENTS = "record long, start long, end long, duration_s double, depth double, nadir double, area double"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _six(x: float) -> float:
    """As ``r6`` rounds: the half of a millionth, once multiplied, away from zero."""
    whole = math.floor(m := abs(x * 1e6))
    return math.copysign((whole + (m - whole >= 0.5)) / 1e6, x)


class Track:
    """One record as it comes: the last ``width`` + 1 readings for the baseline, and a scan.

    The baseline of a record of no more than ``width`` readings is another one, so the first ``width``
    readings wait until the record is longer or over.
    """

    def __init__(self, drop: float, width: int, least: int, gap: int, rate: float) -> None:
        self.scan, self.width = DropScan(drop, least, gap, rate), width
        self.n = 0
        self.recent: list[float] = []
        self.ranked: list[float] = []
        self.first: list[float] = []

    def dump(self) -> str:
        return json.dumps({"scan": self.scan.__dict__, "n": self.n, "recent": self.recent, "first": self.first})

    def load(self, text: str) -> None:
        d = json.loads(text)
        self.scan.__dict__.update(d["scan"])
        self.n, self.recent, self.first = d["n"], d["recent"], d["first"]
        self.ranked = sorted(self.recent)

    def _baseline(self, x: float) -> float:
        self.recent.append(x)
        insort(self.ranked, x)
        if len(self.recent) > self.width + 1:
            del self.ranked[bisect_left(self.ranked, self.recent.pop(0))]
        at = 0.9 * (len(self.ranked) - 1)
        low = int(at)
        high = min(low + (at > low), len(self.ranked) - 1)
        return _six(self.ranked[low] if low == high else (high - at) * self.ranked[low] + (at - low) * self.ranked[high])

    def feed(self, x: float) -> list[tuple]:
        self.n += 1
        if self.n <= self.width:
            self.first.append(x)
            return []
        out, at = [], self.n - 1 - len(self.first)
        for k, v in enumerate([*self.first, x]):
            if e := self.scan.feed(at + k, v, self._baseline(v)):
                out.append(e)
        self.first.clear()
        return out

    def end(self) -> list[tuple]:
        """The events that the end of the record closes."""
        out, top = [], float("-inf")
        for k, v in enumerate(self.first):  # the record was short
            top = max(top, min(v, 100.0))
            if e := self.scan.feed(k, v, _six(top)):
                out.append(e)
        if e := self.scan.close():
            out.append(e)
        return out


class Desaturations(StatefulProcessor):
    """Readings wait until the watermark has passed them and are then read in order of time.

    They wait as they came, a row of arrays for each piece of a batch.  One timer, at the earliest reading that waits, brings
    up all that the watermark has passed, and is set again while others wait; one ``idle_ms`` after a record's last reading ends
    the record and clears its state.  So a record costs a few calls a batch, and not some for each reading.  State is bounded by the
    readings within the watermark's delay, the window of the baseline, and the gap.  Rows that come after the watermark has passed them are dropped.
    """

    def __init__(self, drop: float, width: int, least: int, gap: int, rate: float, idle_ms: int) -> None:
        self.rule, self.idle_ms = (drop, width, least, gap, rate), idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.track = handle.getValueState("track", "data string, last long")
        self.waiting = handle.getListState("waiting", "ts array<long>, id array<long>, x array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # readings at or below this mark have been read already: a late one would come out of order
        passed, first = timerValues.getCurrentWatermarkInMs(), None
        for pdf in rows:
            new = pdf[pdf.ts_ms > passed]
            if len(new):
                self.waiting.appendValue((new.ts_ms.tolist(), new.id.tolist(), new.spo2.tolist()))
                first = min(int(new.ts_ms.min()), first if first is not None else int(new.ts_ms.min()))
        if first is not None:
            self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, track = timerValues.getCurrentWatermarkInMs(), Track(*self.rule)
        last = None
        if self.track.exists():
            text, last = self.track.get()
            track.load(text)
        held = sorted(r for ts, ids, xs in self.waiting.get() for r in zip(ts, ids, xs, strict=True))
        ready, later = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        out = []
        for ts, _, x in ready:
            if last is not None and ts - last > self.idle_ms:
                out += track.end()
                track = Track(*self.rule)
            out += track.feed(x)
            last = ts
        if ready:
            if later:
                self.waiting.put([tuple(map(list, zip(*later, strict=True)))])
                self.handle.registerTimer(later[0][0])
            else:
                self.waiting.clear()
        if last is not None and passed - last >= self.idle_ms and not (later and later[0][0] - last <= self.idle_ms):
            out += track.end()
            self.track.clear()
        elif ready:
            self.track.update((track.dump(), last))
            self.handle.registerTimer(last + self.idle_ms)
        if out:
            yield pd.DataFrame([(key[0], *e) for e in out], columns=[c.split()[0] for c in EVENTS.split(", ")])

    def close(self) -> None:
        pass


def stream_desaturations(readings: DataFrame, drop: float, width: int, least: int, gap: int = 3, rate: float = 1.0, delay: str = "1 hour", idle_ms: int = 365 * 86_400_000) -> DataFrame:
    """Events of a stream of readings (record, ts, id, spo2): rows appear once an event is over, as ``desaturations`` gives them.

    Readings of a record count in order of ts, then id.  A record is over ``idle_ms`` after its last reading; what
    comes then is a new one.  Null readings and rows later than ``delay`` are dropped.
    """
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = readings.where("record IS NOT NULL AND ts IS NOT NULL AND spo2 IS NOT NULL").withWatermark("ts", delay)
    rows = rows.select(F.col("record").cast("long"), "ts", F.unix_millis("ts").alias("ts_ms"), F.col("id").cast("long"), F.col("spo2").cast("double"))
    return rows.groupBy("record").transformWithStateInPandas(Desaturations(drop, width, least, gap, rate, idle_ms), EVENTS, "append", "eventTime")


def reading_stream(spark: SparkSession, folders: list[str], files_per_batch: int | None = None) -> DataFrame:
    """Readings (record, ts, id, spo2) of event files in folders, as a stream."""
    schema = "event_id long, ts timestamp, user_id long, value double"
    out = None
    for f in folders:
        source = spark.readStream.schema(schema)
        source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source
        one = source.parquet(f)
        out = one if out is None else out.unionByName(one)
    spo2 = r6(F.lit(100.0) - F.least(F.col("value") / 8, F.lit(49.0)))
    return out.select(F.col("user_id").alias("record"), "ts", F.col("event_id").alias("id"), spo2.alias("spo2"))


def run_to_the_end(spark: SparkSession, folder: str, make, files_per_batch: int | None = None) -> DataFrame:
    """Runs make(readings) over the event files of a folder, then lets time pass so that all records end; its rows as a table.

    The end is a reading of a record -1 long after all others, in a folder of its own, read by a second run of the same query.
    A batch that is run again writes the same place.
    """
    path = shared_path(spark, "desaturations")
    empty = spark.createDataFrame([], "event_id long, ts timestamp, user_id long, value double")
    empty.write.parquet(f"{path}/end")
    schema = make(reading_stream(spark, [folder, f"{path}/end"])).schema

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    for last in (False, True):
        if last:
            spark.sql("SELECT 0L AS event_id, TIMESTAMP'2200-01-01 00:00:00' AS ts, -1L AS user_id, 0.0D AS value").write.mode("append").parquet(f"{path}/end")
        q = make(reading_stream(spark, [folder, f"{path}/end"], files_per_batch)).writeStream.outputMode("append").foreachBatch(keep)
        q.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")


def event_readings(spark: SparkSession, sf_dir: str) -> str:
    """The events table as files with times that a stream can read, in the shared folder."""
    path = shared_path(spark, "readings")
    table(spark, sf_dir, "events").select("event_id", F.timestamp_micros(micros()).alias("ts"), "user_id", "value").write.parquet(path)
    return path
