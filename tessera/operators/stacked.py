"""Many logistic models in as many scans as one.

A grid of penalties shares its rows: a round reads them once and every task returns the
gradients and curvatures of all configurations, a row each, so a grid takes as many scans as its
slowest member.  The quadratic problem of a round, with its elastic-net penalty, is solved by
coordinate descent on the driver's small matrices:

    mean log loss + reg (l1_ratio |b|_1 + (1 - l1_ratio)/2 |b|^2),   b for standardised features.

A step that raises its objective is halved until it does not.  Where the curvatures of all
configurations would be more than ``CURVATURES`` numbers a task, the bound of Boehning and Lindsay
(1988) takes their place: a quarter of the features' covariance, one matrix for all of them from one
scan; that needs more rounds and sends gradients only.  Configurations that have settled are left
out of further rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.moments import _FAN, Moments, _added, descend, fold_moments, predict

_SUMS = "config int, part int, sums array<double>"
CURVATURES = 1 << 22


def _gradients(sent, curved: bool):
    """By configuration: loss, gradient and, if asked for, curvature of the rows, for (1, standardised x)."""
    def run(batches):
        mean, std, numbers, coef = sent.value
        p = coef.shape[1]
        total = np.zeros((len(coef), 1 + p + (p * p if curved else 0)))
        for batch in batches:
            if batch.num_rows:
                z = np.ones((batch.num_rows, p))
                z[:, 1:] = (batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - mean) / std
                y, v = batch.column(1).to_numpy(zero_copy_only=False)[:, None], z @ coef.T
                said = _sigmoid(v)
                total[:, 0] += (np.logaddexp(0, v) - y * v).sum(axis=0)
                total[:, 1:p + 1] += (said - y).T @ z
                if curved:
                    for i, w in enumerate((said * (1 - said)).T):
                        total[i, p + 1:] += ((z * w[:, None]).T @ z).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([TaskContext.get().partitionId() // _FAN] * len(numbers), pa.int32()),
                                          pa.array(list(total), pa.list_(pa.float64()))], ["config", "part", "sums"])
    return run


def _sigmoid(v: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(v))
    return np.where(v >= 0, 1 / (1 + e), e / (1 + e))


def _step(b: np.ndarray, g: np.ndarray, h: np.ndarray, reg: float, ratio: float) -> np.ndarray:
    """Intercept and coefficients that minimise the quadratic model at ``b`` with the penalty."""
    cross, inner = h[0, 1:] / h[0, 0], h[1:, 1:] - np.outer(h[0, 1:], h[0, 1:]) / h[0, 0]
    slope = g[1:] - g[0] * cross
    new = descend(Moments(1.0, b[1:], 0.0, inner, inner @ b[1:] - slope, 0.0), reg, ratio, b[1:], tol=1e-12)
    return np.append(b[0] - g[0] / h[0, 0] - cross @ (new - b[1:]), new)


def fit_logistic(rows: DataFrame, configs: Sequence[tuple[float, float]], x: str = "x", label: str = "label",
                 rounds: int = 500, tol: float = 1e-9, curvatures: int = CURVATURES) -> np.ndarray:
    """(configs, 1 + features) intercepts and coefficients, in the features' own units.

    ``configs`` are (reg, l1_ratio); ``rows`` is read once before and once a round, so hand over
    a written or checkpointed table.  A constant feature gets 0; labels are 0 and 1, both there."""
    m = fold_moments(rows, F.lit(0), x, label).without()
    if not 0 < m.y_mean < 1:
        raise ValueError("both classes are needed for a fit")
    std = np.sqrt(np.diag(m.cov) * m.n / max(m.n - 1, 1))
    std[~(std > 1e-12 * np.maximum(1.0, np.abs(m.mean)))] = np.inf
    p = len(std) + 1
    bound = np.zeros((p, p))
    bound[0, 0], bound[1:, 1:] = 0.25, m.cov / np.outer(std, std) / 4
    now = np.zeros((len(configs), p))
    now[:, 0] = np.log(m.y_mean / (1 - m.y_mean))
    before: list = [None] * len(configs)                                           # the last accepted point and its objective
    data = rows.select(F.col(x).alias("x"), F.col(label).cast("double").alias("y"))
    live, sc = list(range(len(configs))), rows.sparkSession.sparkContext
    curved = len(configs) * p * p <= curvatures
    for _ in range(rounds):
        sent = sc.broadcast((m.mean, std, live, now[live]))
        sums = data.mapInArrow(_gradients(sent, curved), _SUMS).groupBy("config", "part").applyInPandas(_added, _SUMS)
        sums = sums.groupBy("config").applyInPandas(_added, _SUMS).collect()       # a row a configuration
        sent.unpersist()
        for r in sums:
            i, s = r["config"], np.array(r["sums"]) / m.n
            reg, ratio = configs[i]
            b = now[i].copy()
            worth = s[0] + reg * (ratio * np.abs(b[1:]).sum() + (1 - ratio) / 2 * b[1:] @ b[1:])
            if before[i] is not None and worth > before[i][1] + 1e-12 * max(1.0, abs(worth)):
                now[i] = (b + before[i][0]) / 2                                    # too far
                continue
            before[i] = b, worth
            now[i] = _step(b, s[1:p + 1], s[p + 1:].reshape(p, p) if curved else bound, reg, ratio)
            if np.abs(now[i] - b).max() <= tol * max(1.0, np.abs(now[i]).max()):
                live.remove(i)
        if not live:
            break
    own = now[:, 1:] / std
    return np.column_stack([now[:, 0] - own @ m.mean, own])


def probability(rows: DataFrame, coef: np.ndarray, x: str = "x", out: str = "p") -> DataFrame:
    """``rows`` with one model's probability of class 1, by built-in functions."""
    return predict(rows, coef, x, "_v").withColumn(out, 1.0 / (1.0 + F.exp(-F.col("_v")))).drop("_v")


def _counts(sent, threshold: float):
    def run(batches):
        coef, total = sent.value, None
        total = np.zeros((len(coef), 4), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                said = _sigmoid(x @ coef[:, 1:].T + coef[:, 0]) > threshold
                true = batch.column(1).to_numpy(zero_copy_only=False)[:, None] == 1
                total += np.stack([(said & true).sum(axis=0), (said & ~true).sum(axis=0), (~said & ~true).sum(axis=0), (~said & true).sum(axis=0)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(coef), dtype=np.int32)), *[pa.array(c) for c in total.T]], ["config", "tp", "fp", "tn", "fn"])
    return run


def confusion_of_all(rows: DataFrame, coefs: np.ndarray, threshold: float = 0.5, x: str = "x", label: str | Column = "label") -> DataFrame:
    """(config, tp, fp, tn, fn, precision, recall, accuracy) of every model in one scan; an empty denominator gives 0."""
    sent = rows.sparkSession.sparkContext.broadcast(coefs)
    data = rows.select(F.col(x).alias("x"), F.col(label).cast("double").alias("y"))
    out = data.mapInArrow(_counts(sent, threshold), "config int, tp bigint, fp bigint, tn bigint, fn bigint") \
        .groupBy("config").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])
    share = lambda a, b, name: F.coalesce(F.try_divide(a, b), F.lit(0.0)).alias(name)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return out.select("*", share(tp, tp + fp, "precision"), share(tp, tp + fn, "recall"), share(tp + tn, tp + fp + tn + fn, "accuracy"))
