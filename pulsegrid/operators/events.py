"""Intervals and point events: runs, merging, as-of pairing, range joins, window labels."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import flags, ladder, r6, ratio


def _by(*order: str) -> Window:
    return Window.partitionBy("record").orderBy(*order)


def runs(samples: DataFrame, flag: Column, least: int) -> DataFrame:
    """Maximal runs of flagged samples of at least ``least``: record, start, end (exclusive), length."""
    rows = samples.withColumn("flag", F.coalesce(flag, F.lit(False))).withColumn("i", F.row_number().over(_by("idx")))
    kept = rows.where("flag").withColumn("island", F.col("i") - F.row_number().over(_by("idx")))
    out = kept.groupBy("record", "island").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"), F.count("*").alias("length"))
    return out.where(F.col("length") >= least).select("record", "start", "end", "length")


def merge_intervals(intervals: DataFrame, gap: float) -> DataFrame:
    """Joins intervals (record, start, end) that begin within ``gap`` of the end of any before: also parts, how many were joined."""
    reach = F.max("end").over(_by("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("new", F.coalesce((F.col("start") > reach + gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("new").over(_by("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("record", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts")).drop("island")


def event_burden(first: DataFrame, second: DataFrame, spans: DataFrame, gap: float) -> DataFrame:
    """Two kinds of intervals merged: events an hour, covered share, and severity (spans: record, seconds)."""
    merged = merge_intervals(first.select("record", "start", "end").unionByName(second.select("record", "start", "end")), gap)
    out = spans.join(merged.groupBy("record").agg(F.count("*").alias("events"), F.sum(F.col("end") - F.col("start")).alias("covered")), "record", "left")
    index = ratio(F.coalesce("events", F.lit(0)) * 3600, F.col("seconds"))
    return out.select(
        "record", F.coalesce("events", F.lit(0)).alias("events"), r6(index).alias("events_per_hour"), r6(ratio(F.coalesce("covered", F.lit(0.0)), F.col("seconds"))).alias("burden"),
        ladder(r6(index), [(300, "severe"), (150, "moderate"), (50, "mild")], "none").alias("severity"),
    )


def _timeline(refs: DataFrame, targets: DataFrame, ref_first: bool, shift_refs: float = 0.0, shift_targets: float = 0.0) -> DataFrame:
    """References and targets (record, t) on one time line per record; at equal times references stand first or last."""
    a = refs.select("record", F.col("t").alias("ref"), F.lit(None).cast("double").alias("target"), (F.col("t") + shift_refs).alias("at"), F.lit(0 if ref_first else 1).alias("side"))
    b = targets.select("record", F.lit(None).cast("double").alias("ref"), F.col("t").alias("target"), (F.col("t") + shift_targets).alias("at"), F.lit(1 if ref_first else 0).alias("side"))
    return a.unionByName(b)


def next_after(refs: DataFrame, targets: DataFrame, least: float = 0.0) -> DataFrame:
    """For each reference the first target strictly after it (after ref + least): record, ref, target or null.

    One sort of both sides by record and time; no join, so a long record costs no pairs.
    """
    line = _timeline(refs, targets, ref_first=False, shift_refs=least)
    ahead = F.first("target", True).over(_by("at", "side").rowsBetween(1, Window.unboundedFollowing))
    return line.withColumn("next", ahead).where("ref is not null").select("record", "ref", F.col("next").alias("target"))


def previous_within(refs: DataFrame, targets: DataFrame, least: float, most: float) -> DataFrame:
    """For each target the latest reference in [t - most, t - least], or null."""
    line = _timeline(refs, targets, ref_first=True, shift_targets=-least)
    behind = F.last("ref", True).over(_by("at", "side").rowsBetween(Window.unboundedPreceding, -1))
    rows = line.withColumn("last", behind).where("target is not null")
    return rows.select("record", "target", F.when(F.col("last") >= F.col("target") - most, F.col("last")).alias("ref"))


def before_next_anchor(anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """For each anchor the first target after it and before the next anchor, or null; next_anchor too."""
    line = _timeline(anchors, targets, ref_first=False)
    ahead = _by("at", "side").rowsBetween(1, Window.unboundedFollowing)
    rows = line.withColumns({"t": F.first("target", True).over(ahead), "n": F.first("ref", True).over(ahead)}).where("ref is not null")
    inside = F.col("n").isNull() | (F.col("t") < F.col("n"))
    return rows.select("record", F.col("ref").alias("anchor"), F.when(inside, F.col("t")).alias("target"), F.col("n").alias("next_anchor"))


def arrival_times(pairs: DataFrame, low: float, high: float, least: int = 3) -> DataFrame:
    """Median and quartile range in ms of delays within [low, high], where there are enough."""
    delay = (F.col("target") - F.col("ref")).alias("d")
    d = pairs.select("record", delay).where(F.col("d").between(low, high))
    out = d.groupBy("record").agg(F.count("*").alias("n"), F.median("d").alias("m"), (F.percentile("d", F.lit(0.75)) - F.percentile("d", F.lit(0.25))).alias("i"))
    return out.where(F.col("n") >= least).select("record", "n", r6(1000 * F.col("m")).alias("median_ms"), r6(1000 * F.col("i")).alias("iqr_ms"))


def range_join(points: DataFrame, ranges: DataFrame, width: float) -> DataFrame:
    """points (record, t, ...) inside ranges (record, start, end, ...), start included and end not.

    Ranges are dealt to all buckets of ``width`` seconds that they touch, points to their own:
    an equi join with a check, for ranges that are not much longer than ``width``.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    dealt = ranges.withColumn("_cell", F.explode(F.sequence(cell("start"), cell("end"))))
    return points.withColumn("_cell", cell("t")).join(dealt, ["record", "_cell"]).where("t >= start and t < end").drop("_cell")


def offset_extreme(refs: DataFrame, points: DataFrame, after: float, until: float) -> DataFrame:
    """The point of the largest |x| at [ref + after, ref + until); the first of equals."""
    ranges = refs.select("record", F.col("t").alias("ref"), (F.col("t") + after).alias("start"), (F.col("t") + until).alias("end"))
    near = range_join(points.select("record", "t", "x"), ranges, 2 * (until - after))
    best = near.groupBy("record", "ref").agg(F.max_by(F.struct("t", "x"), F.struct(F.abs("x"), -F.col("t"))).alias("b"))
    return best.select("record", r6("ref").alias("ref"), r6("b.t").alias("t"), r6("b.x").alias("x"))


def systole_diastole(s1: DataFrame, s2: DataFrame) -> DataFrame:
    """Systole (S1 to S2) and diastole (S2 to next S1): medians, variation and their ratio."""
    p = before_next_anchor(s1, s2).where("target is not null").select("record", (F.col("target") - F.col("anchor")).alias("sys"), (F.col("next_anchor") - F.col("target")).alias("dia"))
    out = p.groupBy("record").agg(
        F.count("*").alias("pairs"), F.median("sys").alias("s"), F.median("dia").alias("d"), ratio(F.stddev_pop("sys"), F.avg("sys")).alias("sc"), ratio(F.stddev_pop("dia"), F.avg("dia")).alias("dc")
    )
    return out.select("record", "pairs", r6("s").alias("systole_s"), r6("d").alias("diastole_s"), r6("sc").alias("systole_cv"), r6("dc").alias("diastole_cv"), r6(ratio(F.col("s"), F.col("d"))).alias("sd_ratio"))


def overlap_labels(windows: DataFrame, annotations: DataFrame, width: float) -> DataFrame:
    """How many annotations (record, start, end) overlap each window (record, w, start, end), and by how much in all."""
    cell = lambda c: F.floor(F.col(c) / width)
    a = annotations.select("record", F.col("start").alias("a0"), F.col("end").alias("a1")).withColumn("_cell", F.explode(F.sequence(F.floor(F.col("a0") / width), F.floor(F.col("a1") / width))))
    w = windows.withColumn("_cell", F.explode(F.sequence(cell("start"), cell("end"))))
    # a pair that shares several cells counts in the first of them
    pairs = w.join(a, ["record", "_cell"]).where((F.col("a0") < F.col("end")) & (F.col("a1") > F.col("start")) & (F.col("_cell") == F.greatest(cell("start"), F.floor(F.col("a0") / width))))
    hit = pairs.groupBy("record", "w").agg(F.count("*").alias("n"), F.sum(F.least("a1", "end") - F.greatest("a0", "start")).alias("s"))
    out = windows.join(hit, ["record", "w"], "left")
    return out.select("record", "w", F.coalesce("n", F.lit(0)).alias("overlaps"), r6(F.coalesce("s", F.lit(0.0))).alias("overlap_s"), F.when(F.col("n") > 0, "event").otherwise("normal").alias("label"))


def majority_labels(points: DataFrame, width: float) -> DataFrame:
    """The most frequent kind in each tumbling window of ``width`` seconds; the first by name of equals."""
    each = points.groupBy("record", F.floor(F.col("t") / width).alias("w"), "kind").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("record", "w").orderBy(F.desc("n"), "kind"))
    total = F.sum("n").over(Window.partitionBy("record", "w"))
    return each.withColumn("rank", rank).withColumn("total", total).where("rank = 1").select("record", "w", F.col("kind").alias("label"), r6(F.col("n") / F.col("total")).alias("share"))


def longitudinal_change(beats: DataFrame) -> DataFrame:
    """First against last value of each record, relative change and flags."""
    out = beats.groupBy("record").agg(F.count("*").alias("n"), F.min_by("x", "idx").alias("first"), F.max_by("x", "idx").alias("last"))
    change = ratio(F.col("last") - F.col("first"), F.abs("first"))
    found = flags((change > 0.2, "rise"), (change < -0.2, "fall"))
    return out.select("record", "n", r6("first").alias("first_value"), r6("last").alias("last_value"), r6(change).alias("change"), F.array_join(found, ",").alias("flags"))


def _scan_pieces(rows: DataFrame, columns: list[str], scan: Callable[[list[np.ndarray], list[np.ndarray]], tuple[int, float]]) -> DataFrame:
    """(record, d, t, tp, iou) for each piece of rows (record, piece, side, columns), scanned as scan(columns of side 0, columns of side 1).

    A window by record and piece has left pieces whole in a task, so they stream through it one after the
    other, in order of columns; there is no group, and so no frame, for each of many small pieces.
    """
    schema = pa.schema([("record", pa.int64()), ("d", pa.int64()), ("t", pa.int64()), ("tp", pa.int64()), ("iou", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def over() -> tuple:
            side, *values = (np.concatenate(c) for c in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]
            return (key[1] if key[0] else None, 0, 0, *scan([v[side == 0] for v in values], [v[side == 1] for v in values]))

        for b in batches:
            out, there = [], b.column(0).is_valid().to_numpy(zero_copy_only=False)
            record, piece, side, *values = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in b.columns)
            new = (record[1:] != record[:-1]) | (there[1:] != there[:-1]) | (piece[1:] != piece[:-1])
            at = [0, *(np.flatnonzero(new) + 1).tolist(), len(record)] if len(record) else []
            for lo, hi in zip(at, at[1:], strict=False):
                k = (bool(there[lo]), int(record[lo]), int(piece[lo]))
                if k != key and parts:
                    out.append(over())
                    parts = []
                key = k
                parts.append([c[lo:hi] for c in (side, *values)])
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
        if parts:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, over(), strict=True))], schema)

    ordered = rows.sortWithinPartitions("record", "piece", *columns).select(F.col("record").cast("long"), F.col("piece").cast("long"), F.col("side").cast("int"), *[F.col(c).cast("double") for c in columns])
    return ordered.mapInArrow(run, "record long, d long, t long, tp long, iou double")


def match_events(detected: DataFrame, truth: DataFrame, tolerance: float) -> DataFrame:
    """One-to-one matching in order of detection: each takes the nearest free truth within tolerance, the first of equals.

    Greedy over time.  No match spans a gap longer than the tolerance, so a record is cut at gaps of
    twice that, and only pieces with both sides are scanned, one after the other in a task: record, tp,
    fp, fn, precision, recall, f1.  Events without a time match nothing.
    """

    def match(*both: list[np.ndarray]) -> tuple[int, float]:
        (d,), (t,) = ([c.tolist() for c in g] for g in both)
        free, at, tp = [], 0, 0  # times that are free and near, and the next to come; equal ones are alike
        for x in d:
            while at < len(t) and t[at] - x <= tolerance:
                free.append(t[at])
                at += 1
            del free[: bisect_left(free, True, key=lambda v: x - v <= tolerance)]
            k = bisect_right(free, x)
            if k == len(free) or k and x - free[k - 1] <= free[k] - x:
                k -= 1
            if k >= 0:
                del free[k]
                tp += 1
        return tp, 0.0

    both = detected.select("record", "t", F.lit(0).alias("side")).unionByName(truth.select("record", "t", F.lit(1).alias("side")))
    new = F.coalesce((F.col("t") - F.lag("t").over(_by("t")) > 2 * tolerance).cast("int"), F.lit(0))
    pieces = both.withColumn("new", new).withColumn("piece", F.sum("new").over(_by("t").rowsBetween(Window.unboundedPreceding, 0)))
    piece = Window.partitionBy("record", "piece")
    mixed = pieces.withColumn("mixed", F.min("side").over(piece) < F.max("side").over(piece)).where("mixed")
    matched = _scan_pieces(mixed.where("t IS NOT NULL AND NOT isnan(t)"), ["t"], match).drop("iou")
    counts = both.groupBy("record").agg(F.count_if(F.col("side") == 0).alias("d"), F.count_if(F.col("side") == 1).alias("t"), F.lit(0).cast("long").alias("tp"))
    out = counts.unionByName(matched).groupBy("record").agg(F.sum("d").alias("d"), F.sum("t").alias("t"), F.sum("tp").alias("tp"))
    p, r = (F.when(F.col(c) > 0, F.col("tp") / F.col(c)).otherwise(0.0) for c in "dt")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return out.select(
        F.col("record").cast("long"), "tp", (F.col("d") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"),
        r6(p).alias("precision"), r6(r).alias("recall"), r6(f1).alias("f1"),
    )


def match_intervals(detected: DataFrame, truth: DataFrame, rule: str, tolerance: float) -> DataFrame:
    """One-to-one matching of intervals (record, start, end) in order, by one of three rules: record, tp, fp, fn, precision, recall, f1, mean_iou.

    ``edges``: each detection takes the free truth with both ends within tolerance and the least sum of differences.
    ``overlap``: each takes the free truth it overlaps most, for ``tolerance`` seconds at least.
    ``after``: each truth takes the first free detection that starts at most ``tolerance`` after its start.
    The first of equals counts.  No match reaches across a gap of more than the tolerance, so a
    record is cut there, and only pieces with both sides are scanned, one after the other in a task.
    """

    def score(a: tuple, b: tuple) -> float | None:
        if rule == "edges":
            ok = abs(a[0] - b[0]) <= tolerance and abs(a[1] - b[1]) <= tolerance
            return abs(a[0] - b[0]) + abs(a[1] - b[1]) if ok else None
        if rule == "overlap":
            shared = min(a[1], b[1]) - max(a[0], b[0])
            return -shared if shared > 0 and shared >= tolerance else None
        return b[0] - a[0] if 0 <= b[0] - a[0] <= tolerance else None

    def match(*both: list[np.ndarray]) -> tuple[int, float]:
        sides = [list(zip(*(c.tolist() for c in g), strict=True)) for g in both]
        asks, held = sides if rule != "after" else sides[::-1]
        near_by, at, iou = [], 0, []  # free ones of ``held`` that may still match, and the next to come
        for a in asks:
            while at < len(held) and held[at][0] <= (a[1] if rule == "overlap" else a[0] + tolerance):
                near_by.append(at)
                at += 1
            near_by = [j for j in near_by if (held[j][1] > a[0] if rule == "overlap" else held[j][0] >= a[0] - (tolerance if rule == "edges" else 0.0))]
            near = [(s, j) for j in near_by if (s := score(a, held[j])) is not None]
            if near:
                b = held[min(near)[1]]
                near_by.remove(min(near)[1])
                iou.append(max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / max(max(a[1], b[1]) - min(a[0], b[0]), 1e-12))
        return len(iou), float(sum(iou))

    side = lambda d, k: d.select("record", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.lit(k).alias("side"))
    both = side(detected, 0).unionByName(side(truth, 1))
    order = _by("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > reach + max(tolerance, 0.0)).cast("int"), F.lit(1))
    pieces = both.withColumn("new", new).withColumn("piece", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    piece = Window.partitionBy("record", "piece")
    mixed = pieces.withColumn("mixed", F.min("side").over(piece) < F.max("side").over(piece)).where("mixed")
    matched = _scan_pieces(mixed, ["start", "end"], match)
    counts = both.groupBy("record").agg(F.count_if(F.col("side") == 0).alias("d"), F.count_if(F.col("side") == 1).alias("t"), F.lit(0).cast("long").alias("tp"), F.lit(0.0).alias("iou"))
    out = counts.unionByName(matched).groupBy("record").agg(*[F.sum(c).alias(c) for c in ("d", "t", "tp", "iou")])
    p, r = ratio(F.col("tp"), F.col("d")), ratio(F.col("tp"), F.col("t"))
    return out.select(
        F.col("record").cast("long"), "tp", (F.col("d") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"), r6(p).alias("precision"), r6(r).alias("recall"),
        r6(ratio(2 * p * r, p + r)).alias("f1"), r6(ratio(F.col("iou"), F.col("tp"))).alias("mean_iou"),
    )
