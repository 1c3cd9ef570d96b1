"""Embedding whitening: distributed covariance, its leading eigenvectors, and a broadcast projection."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialize

ROWS = 4096
EPS = np.finfo(float).eps
_MOMENTS = "i int, high long, low long, n long"
_PRODUCTS = "i int, j int, v double"


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Householder reduction of a symmetric matrix: diagonal, off-diagonal, and the unit reflectors with their first index."""
    a, reflectors = np.array(a, float), []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k]
        top = np.abs(x).max()
        if np.abs(x[1:]).max(initial=0.0) == 0.0:
            continue
        v = x / top
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        reflectors.append((k + 1, v))
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def count_below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues lie below each x, from the signs of the pivots."""
    tiny = EPS * max(1e-300, np.abs(off).max(initial=0.0), np.abs(diagonal).max(initial=0.0))
    below, q = np.zeros(len(x), int), np.ones(len(x))
    for k, d in enumerate(diagonal):
        q = d - x - (off[k - 1] ** 2 / q if k else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, many: int) -> np.ndarray:
    """The largest eigenvalues, falling, each bisected until its bracket has no double inside or is far below rounding."""
    n = len(diagonal)
    reach = np.abs(np.append(off, 0.0)) + np.abs(np.append(0.0, off))
    size = max((np.abs(diagonal) + reach).max(), 1e-300)
    want = np.arange(n, n - many, -1)  # the k-th smallest, from the largest down
    low, high = np.full(many, -1.01 * size), np.full(many, 1.01 * size)
    for _ in range(120):
        mid = (low + high) / 2
        under = count_below(diagonal, off, mid) >= want
        high, low = np.where(under, mid, high), np.where(under, low, mid)
    return (low + high) / 2


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """Solves (T - shift) y = b by elimination with row exchanges; a zero pivot becomes a tiny one."""
    n = len(diagonal)
    tiny = EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), 1e-300)
    rows = np.zeros((n, 3))
    y = b.copy()
    now = np.array([diagonal[0] - shift, off[0] if n > 1 else 0.0, 0.0])
    for k in range(n - 1):
        under = np.array([off[k], diagonal[k + 1] - shift, off[k + 1] if k + 2 < n else 0.0])
        if abs(under[0]) > abs(now[0]):
            now, under = under, now
            y[k], y[k + 1] = y[k + 1], y[k]
        if abs(now[0]) < tiny:
            now[0] = tiny
        factor = under[0] / now[0]
        rows[k] = now
        y[k + 1] -= factor * y[k]
        now = np.array([under[1] - factor * now[1], under[2] - factor * now[2], 0.0])
    rows[n - 1] = now if abs(now[0]) >= tiny else (tiny, 0.0, 0.0)
    for k in range(n - 1, -1, -1):
        y[k] -= rows[k, 1] * (y[k + 1] if k + 1 < n else 0.0) + rows[k, 2] * (y[k + 2] if k + 2 < n else 0.0)
        y[k] /= rows[k, 0]
        if abs(y[k]) > 1e200:
            y *= 1e-200
    return y


def leading_vectors(a: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``many`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Householder tridiagonalisation, Sturm-count bisection, inverse iteration.  Vectors of
    eigenvalues closer together than a thousandth of the largest are a cluster: each is made
    orthogonal to the ones before it in every step.
    """
    n = len(a)
    many = min(many, n)
    scale = np.abs(a).max(initial=0.0)
    if not scale:
        return np.zeros(many), np.eye(n, many)
    diagonal, off, reflectors = tridiagonal(np.asarray(a, float) / scale)
    values = leading_values(diagonal, off, many)
    rng, vectors, first = np.random.default_rng(0), np.zeros((n, many)), 0
    for k in range(many):
        if k and values[k - 1] - values[k] > 1e-3 * np.abs(values).max():
            first = k
        # equal values get shifts a few roundings apart
        shift = values[k] - 4 * EPS * (k - first) * np.abs(values).max()
        y = rng.standard_normal(n)
        for _ in range(8):
            y = solve_shifted(diagonal, off, shift, y / np.linalg.norm(y))
            y /= np.abs(y).max()
            for _ in range(2):
                y -= vectors[:, first:k] @ (vectors[:, first:k].T @ y)
            y /= np.linalg.norm(y)
        vectors[:, k] = y
    for at, v in reversed(reflectors):
        vectors[at:] -= 2 * np.outer(v, v @ vectors[at:])
    vectors -= vectors @ np.triu(vectors.T @ vectors, 1)  # clusters apart may still meet by a rounding
    return values * scale, vectors / np.linalg.norm(vectors, axis=0)


def integral(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vectors are whole, with x = floor(256 c) as array<long> instead of the vector.

    Vectors that are null or empty, or hold null or non-finite entries, are dropped.
    """
    c = F.col(vector)
    whole = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    keep = F.coalesce((F.size(c) > 0) & whole, F.lit(False))
    rest = [F.col(k) for k in embeddings.columns if k != vector]
    return embeddings.where(keep).select(*rest, F.transform(c, lambda e: F.floor(e.cast("double") * 256.0)).alias(vector))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return np.asarray(column.flatten()).reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def moments(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and their exact sum in each dimension; a task sends a row a dimension."""

    def run(batches):
        high = low = None
        n = 0
        for b in batches:
            x = _matrix(b.column(0))
            if len(x):
                parts = ((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))
                high, low = parts if n == 0 else (high + parts[0], low + parts[1])
                n += len(x)
        if n:
            d = len(high)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(high), pa.array(low), pa.array([n] * d, pa.int64())], ["i", "high", "low", "n"])

    big = [F.sum(F.col(k).cast("decimal(38,0)")).alias(k) for k in ("high", "low", "n")]
    rows = sorted(fit.mapInArrow(run, _MOMENTS).groupBy("i").agg(*big).collect())  # a row a dimension
    return (int(rows[0]["n"]) if rows else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in 64 bits where it fits, else in Python's integers."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n, centred before it is multiplied; a task sends half a matrix, Spark adds them up."""
    d = len(sums)
    upper = np.triu_indices(d)

    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                y = (centred(_matrix(b.column(0)), n, sums) / n).astype(float)
                total += y.T @ y
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], ["i", "j", "v"])

    out = np.zeros((d, d))
    for r in fit.mapInArrow(run, _PRODUCTS).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # dimensions squared, whatever the rows
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / n
    return out


def squares(y: np.ndarray) -> pa.Array:
    """The sums of squares of whole numbers by row, exact; null beyond 64 bits."""
    rough = (y.astype(float) ** 2).sum(axis=1)
    if y.dtype != object and rough.max(initial=0.0) < 9e18:
        return pa.array((y * y).sum(axis=1), pa.int64())
    exact = [sum(int(v) ** 2 for v in row) for row in y]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """Projects vectors (vec_id, embedding) on the leading principal components, scaled to unit variance.

    x = floor(256 c) for each entry c, as long (beyond its range the nearest long).  The fit
    list is each distinct x vector once; n is its length and S its sums.  Returns, for each
    row and component: vec_id, component (from 1), n, deviation (sum of (n x - S)^2, exact,
    null beyond a long), whitened ((x - S/n) on the component over the root of its
    eigenvalue), explained (eigenvalue over the trace), identity_error (largest entry of the
    covariance of ``whitened`` over the fit list minus the identity).

    Dropped are vectors that are null or empty or hold null or non-finite entries, and those
    of another length than most vectors have (of lengths equally common, the larger counts).
    Repeated rows and null ids are returned like others.  Components without variance are
    left out, so a table with one distinct vector, or none, gives no rows.  Every task sends
    sums whose size depends on the dimensions only; the eigenvectors of that small matrix are
    found on the driver and go to the tasks.
    """
    spark = embeddings.sparkSession
    arrow_batches(spark, ROWS)
    vectors = integral(embeddings.select("vec_id", "embedding"))
    fit = materialize(vectors.select("embedding").distinct(), "fit")
    size = F.size("embedding").alias("d")
    common = vectors.groupBy(size).agg(F.count("*").alias("m")).orderBy(F.desc("m"), F.desc("d")).first()
    d = common["d"] if common else 0
    vectors, fit = (t.where(F.size("embedding") == d) for t in (vectors, fit))
    n, sums = moments(fit)
    v = covariance(fit, n, sums)
    values, axes = leading_vectors(v, components)
    real = values > d * EPS * np.abs(values).max(initial=0.0)
    values, axes = values[real], axes[:, real]
    k, trace = len(values), float(np.trace(v))
    basis, explained = axes / np.sqrt(values), values / trace

    def project(batches):
        for b in batches:
            y = (centred(_matrix(b.column(0)), n, sums) / n).astype(float) if b.num_rows else np.zeros((0, d))
            yield pa.RecordBatch.from_arrays([pa.array(w) for w in (y @ basis).T], [f"w{c}" for c in range(k)])

    error = 0.0
    if k:
        pairs = [(a, b) for a in range(k) for b in range(a, k)]
        found = fit.mapInArrow(project, ", ".join(f"w{c} double" for c in range(k))).agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
        error = max(abs(got - (a == b)) for (a, b), got in zip(pairs, found, strict=True))
    kind = vectors.schema["vec_id"].dataType

    def run(batches):
        for b in batches:
            if not b.num_rows or not k:
                continue
            y = centred(_matrix(b.column(1)), n, sums)
            w = (y / n).astype(float) @ basis
            rows, of = np.repeat(np.arange(len(y)), k), np.tile(np.arange(k), len(y))
            cols = [b.column(0).take(pa.array(rows)), pa.array(of + 1, pa.int32()), pa.array(np.full(len(rows), n)), squares(y).take(pa.array(rows)), pa.array(w.ravel()), pa.array(explained[of]), pa.array(np.full(len(rows), error))]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
