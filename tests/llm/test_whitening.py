"""Whitening against numpy's own decomposition and exact integers."""

import math

import numpy as np
import pytest

from pulsegrid.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 64, 200])
@pytest.mark.parametrize("make", ["random", "clusters", "diagonal", "low rank", "tiny", "huge", "blocks", "equal"])
def test_leading_vectors(n, make):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    x = rng.standard_normal((3 * n, n))
    a = {
        "random": x.T @ x, "clusters": q @ np.diag(np.repeat([5.0, 4.999999, 1.0], [n // 2, n // 4, n - n // 2 - n // 4])) @ q.T, "diagonal": np.diag(np.arange(n) % 3 + 1.0),
        "low rank": x[:2].T @ x[:2], "tiny": x.T @ x * 1e-200, "huge": x.T @ x * 1e200, "blocks": np.kron(np.eye(n), [[2.0, 1.0], [1.0, 2.0]]), "equal": np.ones((n, n)),
    }[make]
    a = (a + a.T) / 2
    k = min(4, len(a))
    values, vectors = whitening.leading_vectors(a, k)
    want = np.linalg.eigvalsh(a)[::-1][:k]
    size = np.abs(want).max()
    assert np.abs(values - want).max() <= 1e-13 * len(a) * size
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13 * max(1, len(a))
    assert np.abs(a / size @ vectors - vectors * (values / size)).max() < 1e-12


def test_sturm_counts():
    rng = np.random.default_rng(1)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = rng.uniform(-4, 4, 50)
    assert (whitening.count_below(d, e, at) == (values[None] < at[:, None]).sum(axis=1)).all()


def brute(rows):
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    return good, n, sums, e, q, np.trace(v)


def test_whiten(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 9)) * np.linspace(3, 0.5, 9)
    rows = [(i, x.tolist()) for i, x in enumerate(base)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # a third of all rows is one vector
    rows += [rows[7], (None, rows[8][1]), (2000, None), (2001, [None, *rows[1][1][1:]]), (2002, [float("nan")] * 9), (2003, [float("inf"), *rows[1][1][1:]]), (2004, [1.0, 2.0]), (2005, [])]
    good, n, sums, e, q, trace = brute(rows[:-2])
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert len(got) == 4 * len(good) and n == 300
    held, signs = {}, np.zeros(4)
    for r in got:
        held.setdefault((r.vec_id, r.component), []).append(r)
    for i, x in good:
        exact = [n * c - s for c, s in zip(x, sums, strict=True)]
        for k in range(4):
            r = held[i, k + 1][0]
            w = float(np.array(exact) / n @ q[:, k] / math.sqrt(e[k]))
            signs[k] = signs[k] or np.sign(w * r.whitened)
            assert r.n == n and r.deviation == sum(c * c for c in exact)
            assert abs(signs[k] * r.whitened - w) < 1e-9 and abs(r.explained - e[k] / trace) < 1e-12 and r.identity_error < 1e-9
    assert len(held[7, 1]) == 2 and len(held[None, 1]) == 1 and not {i for i, _ in held} & {2000, 2001, 2002, 2003, 2004, 2005}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, [0.0, 0.0]), (2, None)]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_few_dimensions_and_extreme_entries(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [-0.001]), (3, [5.0])], SCHEMA)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in got) == [(1, 1, 3, (3 * 256 - 1535) ** 2), (2, 1, 3, (3 * -1 - 1535) ** 2), (3, 1, 3, (3 * 1280 - 1535) ** 2)]
    got = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 0.0]), (3, [0.0, 5.0])], SCHEMA)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and all(r.deviation is None for r in got if r.vec_id < 3) and all(r.identity_error < 1e-6 for r in got)


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a", "b"), (2, [2.0, 1.0], "a", "b"), (3, [2.0, 7.0], "a", "b")], SCHEMA + ", n string, d string")
    assert whitening.whiten(df).count() == 6
