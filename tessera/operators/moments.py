"""Elastic nets from cross products: one scan serves every fold and every penalty.

A least-squares problem needs of its rows only their number, sums and cross products.
``fold_moments`` gathers them once, a matrix per fold; a training set is the total less its
held-out fold.  Coordinate descent on a matrix then costs nothing of the data, so a path of penalties
over all folds is as cheap as one fit.  A second scan scores all models at once.

Tasks add up dense blocks of rows and send their sums in tiles of ``TILE`` columns, which are
added in two steps, so no task gets a tile from every other one.  Numbers are taken relative to one row,
which keeps the digits of columns far from 0.  The driver holds (features + 2) squared numbers
a fold, at most ``MAX_FEATURES`` features: select before (``stats.select_features``).

The objective is 1/(2n) |y - b0 - Xb|^2 + alpha l1_ratio |b|_1 + alpha (1 - l1_ratio)/2 |b|^2.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE, MAX_FEATURES, _FAN = 256, 2048, 32


@dataclass
class Moments:
    """What a fit needs of its rows: number, means, covariances."""
    n: float
    mean: np.ndarray
    y_mean: float
    cov: np.ndarray
    cov_y: np.ndarray
    var_y: float


class FoldMoments:
    """Cross products of (1, x, y) by fold, relative to the row ``pivot`` (x, y)."""

    def __init__(self, by_fold: dict, pivot: np.ndarray):
        self.by_fold, self.pivot = by_fold, pivot
        self.total = sum(by_fold.values())

    def without(self, fold=None) -> Moments:
        """Of the training set of a fold, or of all rows."""
        m = self.total if fold is None else self.total - self.by_fold[fold]
        n = m[0, 0]
        mean = m[0, 1:] / n
        cov = m[1:, 1:] / n - np.outer(mean, mean)
        at = mean + self.pivot
        return Moments(float(n), at[:-1], float(at[-1]), cov[:-1, :-1], cov[:-1, -1], float(cov[-1, -1]))


def _products(pivot: np.ndarray):
    def run(batches):
        held: dict = {}
        p = len(pivot) + 1
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, x, y = batch.columns
            if x.null_count or x.flatten().null_count or y.null_count or fold.null_count:
                raise ValueError("a row with a NULL fold, feature or target: drop or fill it before the fit")
            z = np.ones((batch.num_rows, p))
            z[:, 1:-1] = x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p - 2) - pivot[:-1]
            z[:, -1] = y.to_numpy(zero_copy_only=False) - pivot[-1]
            fold = fold.to_numpy(zero_copy_only=False)
            for f in np.unique(fold):
                own = z[fold == f]
                held[int(f)] = held.get(int(f), 0.0) + own.T @ own
        part = TaskContext.get().partitionId() // _FAN
        for f, m in held.items():
            tiles = [(i, j) for i in range(0, p, TILE) for j in range(i, p, TILE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * len(tiles), pa.int32()), pa.array([i for i, _ in tiles], pa.int32()), pa.array([j for _, j in tiles], pa.int32()),
                 pa.array([part] * len(tiles), pa.int32()), pa.array([m[i:i + TILE, j:j + TILE].reshape(-1) for i, j in tiles], pa.list_(pa.float64()))],
                ["fold", "i", "j", "part", "sums"])
    return run


_TILES = "fold int, i int, j int, part int, sums array<double>"


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf.iloc[:1].copy()
    out["sums"] = [np.sum(np.stack(pdf["sums"].to_list()), axis=0)]
    return out


def fold_moments(rows: DataFrame, fold: str | Column = "fold", x: str = "x", y: str = "y") -> FoldMoments:
    """One scan of ``rows`` (x is an ARRAY<DOUBLE> of equal length everywhere)."""
    data = rows.select((F.col(fold) if isinstance(fold, str) else fold).cast("int").alias("fold"), F.col(x).alias("x"), F.col(y).cast("double").alias("y"))
    first = data.filter(F.col("y").isNotNull()).limit(1).collect()                # one row
    if not first:
        raise ValueError("no rows to fit")
    if len(first[0]["x"]) > MAX_FEATURES:
        raise ValueError(f"{len(first[0]['x'])} features; at most {MAX_FEATURES} fit the driver's matrix, select before")
    pivot = np.array([*first[0]["x"], first[0]["y"]], float)
    tiles = data.mapInArrow(_products(pivot), _TILES).groupBy("fold", "i", "j", "part").applyInPandas(_added, _TILES)
    tiles = tiles.groupBy("fold", "i", "j").applyInPandas(_added, _TILES)
    p, out = len(pivot) + 1, {}
    for r in tiles.toLocalIterator():                                             # one tile at a time
        m = out.setdefault(r["fold"], np.zeros((p, p)))
        i, j = r["i"], r["j"]
        block = np.array(r["sums"]).reshape(min(TILE, p - i), -1)
        m[i:i + TILE, j:j + TILE] = block
        m[j:j + TILE, i:i + TILE] = block.T
    return FoldMoments(out, pivot)


def descend(m: Moments, alpha: float, l1_ratio: float = 0.5, start: np.ndarray | None = None,
            max_sweeps: int = 10_000, tol: float = 1e-13) -> np.ndarray:
    """Coefficients by cyclic coordinate descent, until a sweep moves none by more than ``tol`` of the largest."""
    b = np.zeros(len(m.cov_y)) if start is None else start.copy()
    slope = m.cov_y - m.cov @ b
    diagonal = np.diag(m.cov)
    for _ in range(max_sweeps):
        moved = 0.0
        for j in range(len(b)):
            weight = diagonal[j] + alpha * (1 - l1_ratio)
            if weight <= 0:
                continue
            rho = slope[j] + diagonal[j] * b[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0.0) / weight
            if new != b[j]:
                slope -= m.cov[:, j] * (new - b[j])
                moved = max(moved, abs(new - b[j]))
                b[j] = new
        if moved <= tol * max(1.0, np.abs(b).max(initial=0.0)):
            break
    return b


def path(m: Moments, alphas: Sequence[float], l1_ratio: float = 0.5) -> dict[float, np.ndarray]:
    """(intercept, coefficients) by penalty, each fit starting from the next larger penalty's."""
    out, b = {}, None
    for a in sorted(alphas, reverse=True):
        b = descend(m, a, l1_ratio, b)
        out[a] = np.append(m.y_mean - m.mean @ b, b)
    return {a: out[a] for a in alphas}


def held_out_mse(moments: FoldMoments, fold, coef: np.ndarray) -> float:
    """Mean squared error of (intercept, coefficients) on a fold's rows, from its cross products alone."""
    m = moments.by_fold[fold]
    off = np.concatenate([[moments.pivot[-1] - coef[0] - moments.pivot[:-1] @ coef[1:]], -coef[1:], [1.0]])
    return float(max(off @ m @ off, 0.0) / m[0, 0])


def cross_validated_mse(moments: FoldMoments, alpha: float, l1_ratio: float) -> float:
    """Mean of the folds' held-out errors; no further scan of the rows."""
    errors = []
    for k in sorted(moments.by_fold):
        train = moments.without(k)
        b = descend(train, alpha, l1_ratio, tol=1e-9)
        errors.append(held_out_mse(moments, k, np.append(train.y_mean - train.mean @ b, b)))
    return float(np.mean(errors))


def optimality(m: Moments, coef: np.ndarray, alpha: float, l1_ratio: float = 0.5) -> float:
    """How far (intercept, coefficients) are from the optimum's conditions: 0 at it."""
    b = coef[1:]
    slope = m.cov_y - m.cov @ b - alpha * (1 - l1_ratio) * b
    off = np.where(b != 0, np.abs(slope - alpha * l1_ratio * np.sign(b)), np.maximum(np.abs(slope) - alpha * l1_ratio, 0.0))
    return float(max(off.max(initial=0.0), abs(coef[0] - (m.y_mean - m.mean @ b))))


def predict(rows: DataFrame, coef: np.ndarray, x: str = "x", out: str = "yhat") -> DataFrame:
    """``rows`` with the model's value, by built-in array functions."""
    b = F.array(*[F.lit(float(v)) for v in coef[1:]])
    return rows.withColumn(out, F.aggregate(F.zip_with(x, b, lambda u, v: u * v), F.lit(float(coef[0])), lambda s, v: s + v))


def _errors(models, fold_of: np.ndarray):
    def run(batches):
        coef, total = models.value, np.zeros((len(fold_of), 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            off = y[:, None] - (x @ coef[:, 1:].T + coef[:, 0])
            off[fold[:, None] != fold_of] = 0.0
            total += np.stack([(fold[:, None] == fold_of).sum(axis=0), np.abs(off).sum(axis=0), (off * off).sum(axis=0)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(fold_of), dtype=np.int32)), *[pa.array(c) for c in total.T]], ["model", "n", "abs", "sq"])
    return run


def cross_validate(rows: DataFrame, alphas: Sequence[float], l1_ratio: float = 0.5, fold: str = "fold", x: str = "x", y: str = "y") -> DataFrame:
    """(fold, alpha, n, mae, mse, coef) of every fold's held-out rows at every penalty: two scans in all."""
    moments = fold_moments(rows, fold, x, y)
    models = [(k, a, c) for k in sorted(moments.by_fold) for a, c in path(moments.without(k), alphas, l1_ratio).items()]
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(np.stack([c for _, _, c in models]))
    data = rows.select(F.col(fold).cast("int").alias("fold"), F.col(x).alias("x"), F.col(y).cast("double").alias("y"))
    sums = data.mapInArrow(_errors(sent, np.array([k for k, _, _ in models])), "model int, n double, abs double, sq double") \
        .groupBy("model").agg(*[F.sum(c).alias(c) for c in ("n", "abs", "sq")])
    named = spark.createDataFrame([(i, k, float(a), c.tolist()) for i, (k, a, c) in enumerate(models)], "model int, fold int, alpha double, coef array<double>")
    return named.join(sums, "model").select("fold", "alpha", F.col("n").cast("bigint").alias("n"), (F.col("abs") / F.col("n")).alias("mae"),
                                            (F.col("sq") / F.col("n")).alias("mse"), "coef")
