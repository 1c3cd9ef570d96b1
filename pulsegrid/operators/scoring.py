"""Scores and how good they are: ranks of scores without a threshold, agreement, and a scorer validated across groups."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..sources.scratch import deleted, shared_path

#: Ranges of scores that are ranked apart; a task sorts the distinct scores of one group and range.
RANGES = 64


def ranked_counts(scores: DataFrame, ranges: int = RANGES) -> DataFrame:
    """For each distinct score of a group: positives and negatives with it, and with lower ones.

    scores: group, truth (boolean), score.  Rows with a null score, a NaN or a null truth are left out; a null
    group is a group.  Rows are first counted by group and score, so ties and common scores
    are one row.  The distinct scores are then dealt to ranges of about equal size, and only
    totals of ranges are summed up over a whole group.
    """
    rows = scores.where("score IS NOT NULL AND NOT isnan(score) AND truth IS NOT NULL").select("group", "truth", F.col("score").cast("double"))
    counts = rows.groupBy("group", "score").agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    steps = [k / ranges for k in range(1, ranges)]
    bounds = counts.agg(F.percentile_approx("score", steps, 10_000).alias("b")).first()["b"] or []
    levels = sorted(set(bounds))
    dealt = counts.withColumn("range", F.size(F.filter(F.array(*map(F.lit, levels)), lambda b: b <= F.col("score"))) if levels else F.lit(0))
    order = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("group", "range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    before = {k: F.coalesce(F.sum(c).over(order), F.lit(0)).alias(k) for k, c in (("p0", "p"), ("n0", "n"))}
    ahead = totals.select(F.col("group").alias("g"), F.col("range").alias("r"), *before.values())
    inside = Window.partitionBy("group", "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns({"p1": F.coalesce(F.sum("pos").over(inside), F.lit(0)), "n1": F.coalesce(F.sum("neg").over(inside), F.lit(0))})
    joined = own.join(ahead, F.col("group").eqNullSafe(F.col("g")) & (F.col("range") == F.col("r")))
    return joined.select("group", "score", "pos", "neg", (F.col("p0") + F.col("p1")).alias("pos_below"), (F.col("n0") + F.col("n1")).alias("neg_below"))


def auroc(scores: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Area under the receiver operating curve by group, ties counting half; null without both kinds."""
    r = ranked_counts(scores, ranges)
    p, n = F.sum("pos"), F.sum("neg")
    pairs = F.sum(F.col("pos").cast("double") * (2 * F.col("neg_below") + F.col("neg")))
    return r.groupBy("group").agg(p.alias("positives"), n.alias("negatives"), r6(F.when((p > 0) & (n > 0), pairs / (2.0 * p * n))).alias("auroc"))


def average_precision(scores: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Mean of the precisions at each distinct score, weighed by the positives gained there; null without positives."""
    r = ranked_counts(scores, ranges)
    totals = r.groupBy(F.col("group").alias("g")).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    r = r.join(totals, F.col("group").eqNullSafe(F.col("g")))
    above = F.col("p") - F.col("pos_below")
    precision = above / (above + F.col("n") - F.col("neg_below"))
    best = F.max(F.when(above > 0, 2.0 * above / (F.col("p") + above + F.col("n") - F.col("neg_below"))))
    return r.groupBy("group", "p").agg(r6(F.sum(F.col("pos") * precision) / F.col("p")).alias("average_precision"), r6(best).alias("best_f1")).select(
        "group", F.col("p").alias("positives"), F.when(F.col("p") > 0, F.col("average_precision")).alias("average_precision"), "best_f1"
    )


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """Agreement of two labels beyond chance by group (group, truth, pred); 1 where both are one and the same label throughout.

    Pairs with a null on either side are left out.  Only counts by label are joined.
    """
    cells = pairs.where("truth IS NOT NULL AND pred IS NOT NULL").groupBy("group", "truth", "pred").agg(F.count("*").alias("n"))
    ends = F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("q")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("q"))))
    margins = cells.select("group", ends.alias("e")).groupBy("group", "e.label").agg(F.sum("e.t").alias("t"), F.sum("e.q").alias("q"))
    chance = margins.groupBy(F.col("group").alias("g")).agg(F.sum(F.col("t").cast("double") * F.col("q")).alias("c"))
    seen = cells.groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("same"))
    both = seen.join(chance, F.col("group").eqNullSafe(F.col("g")))
    po, pe = F.col("same") / F.col("n"), F.col("c") / F.col("n") / F.col("n")
    return both.select("group", "n", r6(po).alias("agreement"), r6(F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0)).alias("kappa"))


@dataclass
class Scorer:
    """A logistic model on standardised features: means and deviations of its training rows, intercept first among the weights."""

    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray

    def raw(self) -> tuple[float, np.ndarray]:
        """Intercept and slopes on the features as they are."""
        slope = self.weights[1:] / self.sd
        return float(self.weights[0] - slope @ self.mean), slope


def _moments(rows: DataFrame, names: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By fold: how many values each feature has, their means and their sums of squares about the mean."""
    aggs = [f(c).alias(f"{k}_{c}") for c in names for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]
    out = {}
    for r in rows.groupBy("fold").agg(*aggs).collect():  # a row a fold
        n = np.array([r[f"n_{c}"] for c in names], float)
        out[r["fold"]] = n, np.array([r[f"m_{c}"] or 0.0 for c in names]), n * np.array([r[f"v_{c}"] or 0.0 for c in names])
    return out


def _without(moments: dict, fold: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of all folds but one."""
    n, mean, square = (np.zeros_like(x) for x in next(iter(moments.values())))
    for k, (m, mu, s) in moments.items():
        if k != fold:
            both = n + m
            gap = mu - mean
            square = square + s + gap**2 * n * m / np.maximum(both, 1)
            mean = mean + gap * m / np.maximum(both, 1)
            n = both
    sd = np.sqrt(square / np.maximum(n, 1))
    return mean, np.where(sd > 0, sd, 1.0)


def fit_folds(rows: DataFrame, names: list[str], folds: int, penalty: float = 1.0, rounds: int = 40) -> dict[int, Scorer]:
    """For each fold, a logistic model of the rows of the others (fold, truth, features), by Newton steps.

    Minimises the sum of log losses plus penalty / 2 times the squared slopes.  A round is one
    job for all folds: each task sends, for each fold, a gradient, a curvature and a loss; the
    driver solves systems of the size of the features.  A step that raises the loss is halved.  Missing
    features count as the training mean.
    """
    moments = _moments(rows, names)
    if not moments:
        return {}
    stats = {f: _without(moments, f) for f in range(folds)}
    m = len(names) + 1
    weights = {f: np.zeros(m) for f in range(folds)}
    before: dict[int, tuple[float, np.ndarray]] = {}
    open_ = set(range(folds))
    cells = m * m + m + 1
    narrow = rows.select("fold", F.col("truth").cast("double").alias("y"), *names)
    for _ in range(rounds):
        now = {f: weights[f] for f in sorted(open_)}

        def run(batches, now=now):
            total = {f: np.zeros(cells) for f in now}
            for b in batches:
                fold, y = np.asarray(b.column(0)), np.asarray(b.column(1))
                x = np.column_stack([b.column(2 + k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in range(m - 1)])
                for f, w in now.items():
                    at = fold != f
                    z = (x[at] - stats[f][0]) / stats[f][1]
                    z = np.column_stack([np.ones(len(z)), np.where(np.isnan(z), 0.0, z)])
                    eta = z @ w
                    p = 1 / (1 + np.exp(-eta))
                    total[f] += np.concatenate([((z * (p * (1 - p))[:, None]).T @ z).ravel(), z.T @ (p - y[at]), [np.sum(np.logaddexp(0, eta) - y[at] * eta)]])
            for f, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([f] * cells, pa.int32()), pa.array(range(cells), pa.int32()), pa.array(v)], ["f", "i", "v"])

        sums = {f: np.zeros(cells) for f in now}
        for r in narrow.mapInArrow(run, "f int, i int, v double").groupBy("f", "i").agg(F.sum("v").alias("v")).collect():
            sums[r["f"]][r["i"]] = r["v"]
        for f, w in now.items():
            free = np.append(0.0, np.full(m - 1, penalty))
            hessian = sums[f][: m * m].reshape(m, m) + np.diag(free) + 1e-12 * np.eye(m)
            gradient, loss = sums[f][m * m : -1] + free * w, sums[f][-1] + (free * w * w).sum() / 2
            if f in before and loss > before[f][0] + 1e-9 * abs(before[f][0]):
                weights[f] = (w + before[f][1]) / 2
                continue
            step = np.linalg.solve(hessian, gradient)
            before[f] = loss, w
            weights[f] = w - step
            if np.abs(step).max() < 1e-10:
                open_.discard(f)
        if not open_:
            break
    return {f: Scorer(*stats[f], weights[f]) for f in range(folds)}


def cross_validated(rows: DataFrame, names: list[str], folds: int = 5, penalty: float = 1.0) -> DataFrame:
    """Out-of-fold scores: rows (group, truth, features, ...) with fold and score.

    All rows of a group are in one fold, so no group is scored by a model that has seen it.  Rows with a
    null truth train nothing and are scored; rows whose training part lacks a kind get its
    rate by the intercept.  Scores are computed by expressions over the rows; an empty table has none.
    """
    placed = rows.withColumn("fold", F.pmod(F.xxhash64("group"), F.lit(folds)).cast("int"))
    path = shared_path(rows.sparkSession, "train")
    placed.where("truth IS NOT NULL").select("fold", "truth", *[F.col(c).cast("double") for c in names]).write.parquet(path)
    models = fit_folds(rows.sparkSession.read.parquet(path), names, folds, penalty)
    deleted(rows.sparkSession, path)
    if not models:
        return placed.withColumn("score", F.lit(None).cast("double"))

    def by_fold(values: list[float]) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("fold"))

    raw = [models[f].raw() for f in range(folds)]
    eta = by_fold([r[0] for r in raw])
    for k, c in enumerate(names):
        eta = eta + by_fold([r[1][k] for r in raw]) * F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), by_fold([models[f].mean[k] for f in range(folds)]))
    return placed.withColumn("score", r6(1 / (1 + F.exp(-eta))))
