"""Best-fit packing: few-document patterns fitted by non-negative least squares."""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, materialize, text_or_empty
from .tokens import word_cache

#: Grid of the lengths in patterns of so many documents; it bounds the patterns at about ten thousand.
GRIDS = {2: 1, 3: 16, 4: 64}
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, k long"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def patterns_for(counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Patterns of up to four occurring lengths that fill a sequence exactly."""
    have = {int(n) for n in np.flatnonzero(counts)}
    out = [(capacity,)] if capacity in have else []
    for size, grid in GRIDS.items():
        for head in combinations_with_replacement(range(grid, capacity, grid), size - 1):
            last = capacity - sum(head)
            if last >= head[-1] and last in have and have.issuperset(head):
                out.append((*head, last))
    return out


def fit_repeats(counts: np.ndarray, patterns: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' use of each length near the histogram in least squares (multiplicative updates)."""
    flat = np.array([n for p in patterns for n in p])
    of = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    size = len(counts)
    h = counts.astype(float)
    goal = np.bincount(of, h[flat], len(patterns))
    x = np.maximum(goal / np.bincount(of, minlength=len(patterns)) / 50, 1e-9)
    for _ in range(rounds):
        used = np.bincount(flat, x[of], size)
        x *= goal / np.maximum(np.bincount(of, used[flat], len(patterns)), 1e-12)
    return x


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal open sequences are handled together."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for n in range(len(counts) - 1, 0, -1):
        left = int(counts[n])
        while left:
            room = next((r for r in range(n, capacity) if open_.get(r)), None)
            if room is None:
                fit = capacity // n  # new sequences, several of this length in each
                full, rest = divmod(left, fit)
                for k, many in ((fit, full), (rest, 1 if rest else 0)):
                    if many:
                        p = (n,) * k
                        open_[capacity - n * k][p] = open_[capacity - n * k].get(p, 0) + many
                break
            p, many = open_[room].popitem()
            now = min(many, left)
            if many > now:
                open_[room][p] = many - now
            q = (*p, n)
            open_[room - n][q] = open_[room - n].get(q, 0) + now
            left -= now
    return [(p, many) for group in open_.values() for p, many in group.items()]


def pack_plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) whose lengths together are exactly the histogram.

    Fitted repeats are rounded down and cut to what is left of each length; the residual
    lengths are packed best-fit.  Of some fractions of the fitted repeats, the one that
    leads to the fewest sequences is taken.
    """
    patterns = patterns_for(counts, capacity)
    x = fit_repeats(counts, patterns) if patterns else np.zeros(0)
    best: list = []
    for share in (1.0, 0.9, 0.75, 0.5, 0.25):
        left, plan = counts.astype(np.int64).copy(), []
        for i in np.argsort(-x, kind="stable"):
            many = int(x[i] * share)
            if not many:
                break
            need = defaultdict(int)
            for n in patterns[i]:
                need[n] += 1
            many = min(many, *(int(left[n]) // k for n, k in need.items()))
            if many:
                plan.append((patterns[i], many))
                for n, k in need.items():
                    left[n] -= k * many
        plan += best_fit(left, capacity)
        if not best or sum(m for _, m in plan) < sum(m for _, m in best):
            best = plan
    return best


def slots_of(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, sequence of that rank, offset) by rank: where the pieces of that length go, in order."""
    out: dict[int, list] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for pattern, many in plan:
        at = 0
        for n in pattern:
            out[n].append((taken[n], base, at))
            taken[n] += many
            at += n
        base += many
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Tokenizes documents and cuts those longer than ``capacity``; pid and k place a piece among those of its length."""

    def run(batches):
        cache, pid = word_cache(path, spaced=False), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        end = np.array([end_id], "<u2").tobytes()
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), cache.encode(b.column(1).to_pylist()), strict=True):
                wide = np.frombuffer(ids + end, "<u2").astype("<u4")
                for piece, start in enumerate(range(0, len(wide), capacity)):
                    part = wide[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), pid, seen[len(part)]))
                    seen[len(part)] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = [c.split()[0] for c in _PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(run, _PIECES)


def pack(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Packs documents (doc_id, text) into as few sequences of ``capacity`` tokens as it can.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Null
    text is empty text, which is the end id alone; null ids and repeated rows are documents
    like others; an empty table gives an empty result.

    The driver gets the histogram of the lengths (at most ``capacity`` rows) and makes a plan
    of patterns and repeats, whose size does not grow with the documents.  Pieces of a
    length, however many, are ranked by their place in a task and the tasks before it.
    """
    arrow_batches(docs.sparkSession)
    pieces = materialize(pieces_of(docs, path, capacity), "pieces")
    per_task = pieces.groupBy("pid", "length").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    place = per_task.withColumn("ahead", F.coalesce(ahead, F.lit(0))).drop("n")
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    slots = slots_of(pack_plan(counts, capacity))

    def put(batches):
        for b in batches:
            length, rank = (np.asarray(b.column(c)) for c in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                s = slots[int(n)]
                i = np.searchsorted(s[:, 0], rank[at], "right") - 1
                seq[at] = s[i, 1] + rank[at] - s[i, 0]
                off[at] = s[i, 2]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], [c.split()[0] for c in _PACKED.split(", ")])

    ranked = pieces.join(place, ["pid", "length"]).withColumn("rank", F.col("ahead") + F.col("k")).drop("pid", "k", "ahead")
    return ranked.mapInArrow(put, _PACKED)
