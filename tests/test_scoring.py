"""Threshold-free metrics against all pairs, and the scorer against plain Newton steps."""

import random
from collections import Counter

import numpy as np
import pytest

from pulsegrid.operators import scoring as op

SCORES = "group string, truth boolean, score double"


def cases(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), rng.random() < 0.4, round(rng.gauss(0, 1), rng.choice([0, 1, 6]))) for _ in range(1500)]
    rows += [("a", True, 0.5)] * 700 + [("a", False, 0.5)] * 300  # a third of all rows have one score
    rows += [("only", True, 1.0), ("only", True, 2.0), ("none", False, 1.0), ("a", None, 1.0), ("a", True, None), ("a", True, float("nan")), ("inf", True, float("inf")), ("inf", False, float("-inf"))]
    return rows


def clean(rows):
    out = {}
    for g, t, s in rows:
        if t is not None and s is not None and s == s:
            out.setdefault(g, []).append((t, s))
    return out


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_auroc_and_average_precision(spark, ranges):
    rows = cases(ranges)
    df = spark.createDataFrame(rows, SCORES).repartition(5)
    roc = {r.group: r for r in op.auroc(df, ranges).collect()}
    ap = {r.group: r for r in op.average_precision(df, ranges).collect()}
    want = clean(rows)
    assert roc.keys() == ap.keys() == want.keys()
    for g, cs in want.items():
        pos, neg = np.array([s for t, s in cs if t]), np.array([s for t, s in cs if not t])
        assert (roc[g].positives, roc[g].negatives) == (len(pos), len(neg))
        if len(pos) and len(neg):
            assert abs(roc[g].auroc - ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)) < 2e-6
        else:
            assert roc[g].auroc is None
        if len(pos):
            total = best = 0.0
            for s in set(pos.tolist()) | set(neg.tolist()):
                tp, fp = (pos >= s).sum(), (neg >= s).sum()
                total += (pos == s).sum() * tp / (tp + fp)
                best = max(best, 2 * tp / (len(pos) + tp + fp))
            assert abs(ap[g].average_precision - total / len(pos)) < 2e-6 and abs(ap[g].best_f1 - best) < 2e-6
        else:
            assert ap[g].average_precision is None


def test_kappa(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b"]), t := rng.choice("xyz"), t if rng.random() < 0.6 else rng.choice("xyzw")) for _ in range(900)]
    rows += [("same", "x", "x")] * 3 + [("cross", "x", "y"), ("cross", "y", "x"), ("a", None, "x"), (None, "x", "x"), (None, "x", "y")]
    got = {r.group: r for r in op.cohen_kappa(spark.createDataFrame(rows, "group string, truth string, pred string")).collect()}
    for g in ("a", "b", "cross", None):
        ps = [(t, p) for k, t, p in rows if k == g and t is not None]
        n, ct, cp = len(ps), Counter(t for t, _ in ps), Counter(p for _, p in ps)
        po, pe = sum(t == p for t, p in ps) / n, sum(ct[k] * cp[k] for k in ct) / n**2
        assert got[g].n == n and abs(got[g].kappa - (po - pe) / (1 - pe)) < 2e-6
    assert got["same"].kappa == 1.0 and op.cohen_kappa(spark.createDataFrame([], "group string, truth string, pred string")).count() == 0


def test_empty_scores(spark):
    df = spark.createDataFrame([], SCORES)
    assert op.auroc(df).count() == op.average_precision(df).count() == 0


def plain_newton(x, y, penalty):
    mean, sd = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    z = np.column_stack([np.ones(len(x)), np.nan_to_num((x - mean) / np.where(sd > 0, sd, 1))])
    w, free = np.zeros(z.shape[1]), np.append(0, np.full(x.shape[1], penalty))
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(free), z.T @ (p - y) + free * w)
    return w, mean, sd


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(8)
    x = rng.normal(3, 2, (700, 3)) * [1, 10, 0.1]
    x[:, 2] += 0.02 * x[:, 0]
    y = rng.random(700) < 1 / (1 + np.exp(-(x[:, 0] - 3 + 0.1 * (x[:, 1] - 30))))
    x[::17, 1] = np.nan
    group = rng.integers(0, 40, 700)
    group[:250] = 7  # one group holds over a third
    return x, y, group


def frame(spark, sample):
    x, y, group = sample
    rows = [(int(g), bool(t), *[None if np.isnan(v) else float(v) for v in r]) for g, t, r in zip(group, y, x, strict=True)]
    return spark.createDataFrame([*rows, (7, None, 1.0, 2.0, 3.0), (None, True, 1.0, None, 0.3)], "group long, truth boolean, a double, b double, c double").repartition(6)


def test_coefficients_equal_plain_newton(spark, sample):
    df = op.cross_validated(frame(spark, sample), ["a", "b", "c"], 4)
    rows = df.where("truth IS NOT NULL").toPandas()
    models = op.fit_folds(df.where("truth IS NOT NULL").select("fold", "truth", "a", "b", "c"), ["a", "b", "c"], 4)
    for f, m in models.items():
        at = (rows.fold != f).to_numpy()
        w, mean, sd = plain_newton(rows[["a", "b", "c"]].to_numpy(float)[at], rows.truth.to_numpy(float)[at], 1.0)
        assert np.abs(m.weights - w).max() < 1e-8 and np.allclose(m.mean, mean, atol=1e-10) and np.allclose(m.sd, sd, atol=1e-10)
        held = rows[rows.fold == f]
        z = np.nan_to_num((held[["a", "b", "c"]].to_numpy(float) - mean) / sd)
        assert np.abs(held.score.to_numpy() - 1 / (1 + np.exp(-(w[0] + z @ w[1:])))).max() < 1e-6
    assert rows.groupby("group").fold.nunique().max() == 1
    ranks = op.auroc(df.select("fold", "truth", "score").withColumnRenamed("fold", "group")).collect()
    assert np.mean([r.auroc for r in ranks]) > 0.8


def test_scores_of_all_rows(spark, sample):
    got = op.cross_validated(frame(spark, sample), ["a", "b"], 3)
    assert got.columns == ["group", "truth", "a", "b", "c", "fold", "score"] and got.where("score IS NULL").count() == 0 and got.count() == 702
    assert op.cross_validated(frame(spark, sample).limit(0), ["a"], 3).count() == 0


def test_separable_and_constant(spark):
    rows = [(k % 9, k % 2 == 0, float(k % 2), 5.0) for k in range(90)]
    got = op.cross_validated(spark.createDataFrame(rows, "group long, truth boolean, a double, b double"), ["a", "b"], 3).collect()
    assert all((r.score > 0.5) == r.truth for r in got)
    one = [(k, True, float(k), 1.0) for k in range(20)]
    assert all(r.score > 0.9 for r in op.cross_validated(spark.createDataFrame(one, "group long, truth boolean, a double, b double"), ["a"], 2).collect())
