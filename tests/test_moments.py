"""Elastic nets from cross products against direct solutions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import moments as MO


def _rows(n=300, p=7, seed=2, offset=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) + offset
    x[:, -1] = 3.0                                            # constant
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(size=n) + 40
    return x, y, np.arange(n) * 4 // n


def _direct(x, y, alpha, l1, sweeps=4000):
    xc, yc = x - x.mean(axis=0), y - y.mean()
    b, n = np.zeros(x.shape[1]), len(y)
    for _ in range(sweeps):
        for j in range(len(b)):
            rho = xc[:, j] @ (yc - xc @ b + xc[:, j] * b[j]) / n
            b[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - l1))
    return np.append(y.mean() - x.mean(axis=0) @ b, b)


@pytest.mark.parametrize("offset,tile", [(0.0, 256), (1e6, 3)])
def test_folds_and_penalties(spark, monkeypatch, offset, tile):
    monkeypatch.setattr(MO, "TILE", tile)
    x, y, fold = _rows(offset=offset)
    df = spark.createDataFrame([(int(f), a.tolist(), float(b)) for f, a, b in zip(fold, x, y)], "fold int, x array<double>, y double").repartition(5)
    got = {(r.fold, r.alpha): r for r in MO.cross_validate(df, [0.05, 0.4, 50.0], 0.5).collect()}
    assert len(got) == 12
    for (k, a), r in got.items():
        want = _direct(x[fold != k], y[fold != k], a, 0.5, 600)
        assert np.abs(np.array(r.coef)[1:] - want[1:]).max() < 1e-5
        off = y[fold == k] - (x[fold == k] @ want[1:] + want[0])
        assert r.n == (fold == k).sum() and abs(r.mae - np.abs(off).mean()) < 1e-3 and abs(r.mse - (off ** 2).mean()) < 1e-3
        assert a < 50 or not any(r.coef[1:])
    m = MO.fold_moments(df)
    for a, c in MO.path(m.without(2), [0.01, 0.3], 0.7).items():
        assert MO.optimality(m.without(2), c, a, 0.7) < 1e-9
        assert MO.optimality(m.without(2), c + 0.01, a, 0.7) > 1e-4
    whole = MO.path(m.without(), [0.3])[0.3]
    shown = MO.predict(df, whole).select("x", "yhat").collect()
    assert all(abs(r.yhat - (np.array(r.x) @ whole[1:] + whole[0])) < 1e-6 for r in shown)


def test_moments_of_one_scan_are_numpys(spark):
    x, y, fold = _rows(50, 4)
    df = spark.createDataFrame([(int(f), a.tolist(), float(b)) for f, a, b in zip(fold, x, y)], "fold int, x array<double>, y double")
    m = MO.fold_moments(df.repartition(7)).without(1)
    own = fold != 1
    assert m.n == own.sum() and np.allclose(m.mean, x[own].mean(axis=0)) and np.allclose(m.cov, np.cov(x[own].T, bias=True)) and abs(m.var_y - y[own].var()) < 1e-9


def test_refuses_nulls_empty_and_too_many_features(spark, monkeypatch):
    schema = "fold int, x array<double>, y double"
    with pytest.raises(ValueError):
        MO.fold_moments(spark.createDataFrame([], schema))
    with pytest.raises(Exception, match="NULL"):
        MO.fold_moments(spark.createDataFrame([(0, [1.0, None], 1.0), (1, [1.0, 2.0], 1.0)], schema))
    monkeypatch.setattr(MO, "MAX_FEATURES", 1)
    with pytest.raises(ValueError, match="select before"):
        MO.fold_moments(spark.createDataFrame([(0, [1.0, 2.0], 1.0)], schema))
