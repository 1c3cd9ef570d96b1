"""Embedding near-dedup: collision counts over many sorted one-dimensional projections.

A unit vector is projected on random lines.  Two vectors at cosine c differ by a normal
deviate of scale d = sqrt(2 - 2 c) on each line, independently.  So a pair at the threshold
falls into the window of WINDOW * d around the query on a known share of lines, and the count
of collisions that such a pair reaches with probability RECALL follows from the binomial.  On
GATES further lines a pair must be nearer than a wide gap, which parts a share of PARTED.  These
conditions are the same for every pair, so whether a link is found does not depend on how many
vectors a label has.  Gates are also what candidates are found by: strips on the first ones say
which vectors meet in a task, the last one is sorted there, and the rest thin out what its
windows hold before collisions are counted, pair by pair, for what is left.
"""

from __future__ import annotations

import hashlib
import math
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, connected_components, materialize

#: Lines that are counted, and the half width of their windows in units of d.
LINES = 24
WINDOW = 1.5
#: Shares of pairs at the threshold that reach the count, and that the gates part at most.
RECALL = 0.995
PARTED = 0.003
#: Lines on which every pair must be near, and candidates held at once.
GATES = 6
PAIRS = 500_000
#: Vectors in a block of a cell.
BLOCK = 2048
#: A label of more vectors is cut along so many gates into strips as wide as their gap.  This steers the work and changes no link.
STRIP_LINES = ((0, 1), (5_000, 2), (80_000, 3), (2_000_000, 4))


def strip_width(lines: int, parted: float = PARTED) -> float:
    """The width of strips, in units of d, with which ``lines`` lines together part that share of pairs at the threshold.

    A pair is parted only if it differs by more than the width on some line.
    """
    low, high = 0.0, 40.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid / math.sqrt(2)) ** lines < 1 - parted else (low, mid)
    return high


def least_collisions(lines: int = LINES, window: float = WINDOW, recall: float = RECALL) -> int:
    """The highest count that a pair at the threshold reaches with probability ``recall``."""
    p = math.erf(window / math.sqrt(2))
    tail, k = 0.0, lines
    while k > 0 and tail + math.comb(lines, k) * p**k * (1 - p) ** (lines - k) < recall:
        tail += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        k -= 1
    return k


def random_lines(dim: int, lines: int) -> np.ndarray:
    return np.random.default_rng(1000 + dim).standard_normal((dim, lines))


class Tile:
    """Vectors of a block, which queries are compared with; counts links and joins what is linked."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.many: list[np.ndarray] = []
        self.vectors: list[np.ndarray] = []
        self.ready = False  # arranged, and compared with itself

    def add(self, ids: np.ndarray, many: np.ndarray, vectors: np.ndarray) -> None:
        self.ids.append(ids)
        self.many.append(many)
        self.vectors.append(vectors)

    def links(self, ids: np.ndarray, u: np.ndarray, p: np.ndarray, threshold: float, near: float, window: float, least: int, own: bool = False):
        """Yields arrays of linked (query, member): near on all gates, enough collisions, and then a cosine that reaches the threshold.

        With ``own`` the queries are the members themselves, and each pair comes once.
        """
        lo = np.arange(1, len(ids) + 1) if own else np.searchsorted(self.p[-1], p[-1] - near, "left")
        many = np.maximum(np.searchsorted(self.p[-1], p[-1] + near, "right") - lo, 0)
        ends = np.cumsum(many)
        i = 0
        while i < len(ids):
            before = ends[i] - many[i]
            j = max(i + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
            q = np.repeat(np.arange(i, j), many[i:j])
            m = np.arange(len(q)) - np.repeat(ends[i:j] - many[i:j] - before - lo[i:j], many[i:j])
            for k in range(LINES, LINES + GATES - 1):
                at = np.abs(p[k, q] - self.p[k, m]) <= near
                q, m = q[at], m[at]
            hits = np.zeros(len(q), np.uint8)
            for k in range(LINES):
                # query-centred windows over the sorted projection of the members
                rank = self.rank[k, m]
                start = np.searchsorted(self.sorted[k], p[k, i:j] - window, "left")
                stop = np.searchsorted(self.sorted[k], p[k, i:j] + window, "right")
                hits += (rank >= start[q - i]) & (rank < stop[q - i])
                if k % 6 == 5:  # too many windows missed to reach the count
                    at = hits + (LINES - 1 - k) >= least
                    q, m, hits = q[at], m[at], hits[at]
            for c in range(0, len(q), 50_000):
                x, y = q[c : c + 50_000], m[c : c + 50_000]
                at = (np.einsum("ij,ij->i", u[x], self.u[y]) >= threshold) & (ids[x] != self.id[y])
                if at.any():
                    yield x[at], y[at]
            i = j

    def close(self, lines: np.ndarray) -> None:
        """Arranges the members by the last gate."""
        self.id, self.times, self.u = np.concatenate(self.ids), np.concatenate(self.many), np.concatenate(self.vectors)
        p = self.u @ lines
        by = np.argsort(p[:, -1], kind="stable")
        self.id, self.times, self.u, self.p = self.id[by], self.times[by], self.u[by], np.ascontiguousarray(p[by].T)
        order = np.argsort(self.p[:LINES], axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.p[:LINES], order, axis=1)
        self.rank = np.argsort(order, axis=1).astype(np.int32)
        self.root, self.count = np.arange(len(self.id)), np.zeros(len(self.id), np.int64)
        self.ready = True

    def join(self, members: np.ndarray) -> int:
        roots = np.unique(self.root[members])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]
        return int(roots[0])


def by_query(q: np.ndarray, m: np.ndarray):
    """Each query of sorted pairs with its members."""
    cuts = np.flatnonzero(np.diff(q)) + 1
    return zip(q[np.concatenate([[0], cuts])], np.split(m, cuts), strict=True)


def unit(emb: pa.Array, rows: int) -> np.ndarray:
    """Vectors of one length as unit vectors in double precision."""
    x = np.asarray(emb.flatten()).astype(np.float64).reshape(rows, -1)
    u = x / np.abs(x).max(axis=1, keepdims=True)
    return u / np.sqrt((u * u).sum(axis=1, keepdims=True))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, strip_lines: tuple[tuple[int, int], ...] = STRIP_LINES) -> DataFrame:
    """Links between vectors of one label, and their components.

    vectors: vec_id, embedding, label.  Returns one row per input row: vec_id, n_links (other
    vectors with a cosine of at least ``threshold``), component_id (smallest vec_id reachable),
    kept (vec_id is component_id).  No link is below the threshold; a link just at it is found
    with probability RECALL * (1 - PARTED), 0.992, by a rule that knows only the two vectors:
    ``strip_lines`` (least size of a label, gates that cut it) deals the work otherwise, with the same links.

    Vectors that are null, zero or hold null or non-finite components, and vectors with a
    null label, link with nothing; so do vectors of different length.  Rows without vec_id
    stand alone with a null component and are not kept; rows repeating a vec_id count as
    one vector (the least by label, then components).  Other columns are not read.  An empty
    table gives an empty result.

    Equal vectors of a label (told by 128 bits of their unit vector) are compared once and
    counted as often as they stand, so copies, however many, cost no comparisons.  Pairs
    never leave a task, which holds PAIRS candidates at once: a block counts the links of its vectors and emits one edge for each
    vector that is linked.  A cell with many vectors is cut into blocks of BLOCK.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, 2000)
    gap = math.sqrt(2 - 2 * threshold)
    single = vectors.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>")
    emb = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), emb.alias("embedding"), "label")
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v"))
    good = good.select("vec_id", "v.label", "v.embedding").where(F.col("embedding").isNotNull() & fine)
    kind, item = (good.schema[c].dataType.simpleString() for c in ("label", "embedding"))

    def name(batches):
        for b in batches:
            dims = np.asarray(pc.list_value_length(b.column("embedding")))
            keys: list = [None] * b.num_rows
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                u = unit(b.column("embedding").take(pa.array(at)), len(at)) + 0.0  # no negative zeros
                for i, x in zip(at, u, strict=True):
                    keys[i] = hashlib.md5(x.tobytes()).digest()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims, pa.int32()), pa.array(keys, pa.binary())], [*b.schema.names, "dim", "key"])

    named = materialize(good.mapInArrow(name, f"vec_id long, label {kind}, embedding {item}, dim int, key binary"), "vectors")
    groups = materialize(named.groupBy("label", "dim", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")).where("many > 1"), "copies")
    of = named.select("vec_id", "label", "dim", "key").join(groups, ["label", "dim", "key"]).select("vec_id", "rep", "many")
    of = materialize(of, "members")
    reps = named.drop("key").join(of, "vec_id", "left").where("rep is null or rep = vec_id").drop("rep").fillna(1, ["many"])
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("size"))
    strips = F
    for least_size, lines in sorted(strip_lines, reverse=True):
        strips = strips.when(F.col("size") >= least_size, lines)
    sizes = materialize(sizes.select("label", "dim", strips.cast("int").alias("strips")), "sizes")
    most = max(lines for _, lines in strip_lines)
    near = strip_width(GATES) * gap
    if most >= GATES:
        raise ValueError(f"strips leave no gate to sort by: {most} of {GATES}")

    def place(batches):
        for b in batches:
            cells = np.zeros((b.num_rows, most), np.int64)
            dims, strips = np.asarray(b.column("dim")), np.asarray(b.column("strips"))
            for dim, k in set(zip(dims.tolist(), strips.tolist(), strict=True)):
                at = np.flatnonzero((dims == dim) & (strips == k))
                u = unit(b.column("embedding").take(pa.array(at)), len(at))
                cells[at, :k] = np.floor(u @ random_lines(dim, LINES + GATES)[:, LINES : LINES + k] / (near * (1 + 1e-9)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.tolist(), pa.list_(pa.int64()))], [*b.schema.names, "cell"])

    reps = reps.join(sizes, ["label", "dim"]).select("label", "dim", "vec_id", "embedding", "many", "strips")
    placed = reps.mapInArrow(place, f"label {kind}, dim int, vec_id long, embedding {item}, many long, strips int, cell array<long>")
    placed = materialize(placed, "placed")
    cells = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    cells = materialize(cells, "cells")
    # a vector is a member of its own cell, and asks its own and the greater neighbours
    steps = F
    for k in range(1, most + 1):
        ahead = [(*o, *[0] * (most - k)) for o in product((-1, 0, 1), repeat=k) if o >= (0,) * k]
        steps = steps.when(F.col("strips") == k, F.array(*[F.array(*[F.lit(x).cast("long") for x in o]) for o in ahead]))
    asks = placed.withColumn("step", F.explode(steps)).withColumn("home", F.forall("step", lambda k: k == 0)).withColumn("cell", F.zip_with("cell", "step", lambda a, b: a + b))
    asks = asks.join(cells, ["label", "dim", "cell"])
    mine = F.when(F.col("home"), F.pmod(F.xxhash64("vec_id"), "blocks"))
    asks = asks.withColumn("mine", mine).withColumn("block", F.explode(F.sequence(F.coalesce("mine", F.lit(0).cast("long")), F.col("blocks") - 1)))
    dealt = asks.select("label", "dim", "cell", "block", (~F.coalesce(F.col("mine") == F.col("block"), F.lit(False))).alias("asks"), "vec_id", "many", "embedding")
    least = least_collisions()

    def compare(batches):
        tile, now, lines = None, None, None
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def found(ids, many, u):
            for q, m in tile.links(ids, u, (u @ lines).T, threshold, near, WINDOW * gap, least):
                np.add.at(tile.count, m, many[q])
                parts = [(i, tile.times[of].sum(), tile.id[tile.join(of)]) for i, of in by_query(q, m)]
                of, n, roots = (np.array(x) for x in zip(*parts, strict=True))
                out.append((ids[of], n, roots))

        def finish():
            if tile is None or not tile.ids:
                return
            if not tile.ready:
                ready()
            at = np.flatnonzero(tile.count)
            out.append((tile.id[at], tile.count[at], tile.id[tile.root[at]]))

        def ready():
            """Members are complete: arranges them and compares them with each other."""
            tile.close(lines)
            for q, m in tile.links(tile.id, tile.u, tile.p, threshold, near, WINDOW * gap, least, own=True):
                np.add.at(tile.count, m, tile.times[q])
                np.add.at(tile.count, q, tile.times[m])
                for i, of in by_query(q, m):
                    tile.join(np.append(of, i))

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("label", "dim")), map(tuple, b.column("cell").to_pylist()), b.column("block").to_pylist(), strict=True))
            ask, ids, many, emb = np.asarray(b.column("asks").cast(pa.int8())).astype(bool), np.asarray(b.column("vec_id")), np.asarray(b.column("many")), b.column("embedding")
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or ask[i] != ask[i - 1]), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j == i:
                    continue
                if keys[i] != now:
                    finish()
                    tile, now, lines = Tile(), keys[i], random_lines(keys[i][1], LINES + GATES)
                u = unit(emb.slice(i, j - i), j - i)
                if not ask[i]:
                    tile.add(ids[i:j], many[i:j], u)
                elif tile.ids:
                    if not tile.ready:
                        ready()
                    found(ids[i:j], many[i:j], u)
            if sum(len(o[0]) for o in out) > 10_000:
                yield emit(out)
                out.clear()
        finish()
        if out:
            yield emit(out)

    def emit(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in range(3)], ["vec_id", "n", "other"])

    order = ("label", "dim", "cell", "block")
    found = dealt.repartition(*order).sortWithinPartitions(*order, "asks").mapInArrow(compare, "vec_id long, n long, other long")
    found = materialize(found, "found")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    comps = connected_components(found.select(F.col("vec_id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "vec_id")
    told = counts.join(comps, "vec_id", "full").withColumnRenamed("vec_id", "rep")
    out = rows.select("vec_id").join(of, "vec_id", "left").withColumn("rep", F.coalesce("rep", "vec_id")).join(told, "rep", "left")
    links = F.coalesce("n_links", F.lit(0)) + F.coalesce("many", F.lit(1)) - 1
    out = out.select("vec_id", links.cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
