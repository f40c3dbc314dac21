"""Adaptive search: better than random draws, repeatable, inside its space."""

import math

import numpy as np
import pytest

from tessera.operators import moments as MO
from tessera.operators.adaptive import Parzen, adaptive_search
from tessera.operators.search import param_random

SPACE = {"a": ("uniform", -5.0, 5.0), "b": ("uniform", 0.0, 1.0), "c": ("quniform", 4.0, 15.0, 1.0), "d": ("uniform", 0.001, 0.4)}


def _loss(t):
    return (t["a"] - 1.7) ** 2 + 20 * (t["b"] - 0.9) ** 2 + 0.3 * abs(t["c"] - 6) + 30 * abs(t["d"] - 0.05)


def test_beats_random_draws_and_repeats():
    own, drawn = [], []
    for seed in range(8):
        trials = adaptive_search(SPACE, lambda ts: [_loss(t) for t in ts], 200, seed=seed)
        assert [t["trial"] for t in trials] == list(range(1, 201)) and {t["round"] for t in trials} == set(range(1, 11))
        assert all(s[1] <= t[k] <= s[2] for t in trials for k, s in SPACE.items()) and all(t["c"] == round(t["c"]) for t in trials)
        own.append(min(t["loss"] for t in trials))
        drawn.append(min(map(_loss, param_random(SPACE, 200, seed))))
    assert np.mean(own) < 0.5 * np.mean(drawn) and sum(a < b for a, b in zip(own, drawn)) >= 7
    assert trials == adaptive_search(SPACE, lambda ts: [_loss(t) for t in ts], 200, seed=7)


def test_rounds_failures_and_odd_sizes():
    sizes = []
    trials = adaptive_search(SPACE, lambda ts: sizes.append(len(ts)) or [math.nan if t["trial"] % 3 else _loss(t) for t in ts], 33, 10)
    assert sizes == [10, 10, 10, 3] and len(trials) == 33
    with pytest.raises(ValueError):
        adaptive_search(SPACE, lambda ts: [0.0], 10)


def test_density_sums_to_one_and_draws_follow_it():
    p = Parzen([0.2, 0.25, 0.9, 0.9], 0.0, 2.0)
    x = np.linspace(0, 2, 20001)
    d = np.array([p(v) for v in x])
    assert abs(((d[1:] + d[:-1]) / 2 * np.diff(x)).sum() - 1) < 1e-3
    rng = np.random.default_rng(0)
    drawn = np.array([p.draw(*rng.random(2)) for _ in range(20000)])
    assert abs((drawn < 0.5).mean() - d[x < 0.5].sum() * (x[1] - x[0])) < 0.02
    assert Parzen([], 0.0, 2.0)(1.0) == 0.5


def test_losses_from_moments_are_those_of_the_rows(spark):
    rng = np.random.default_rng(3)
    x, fold = rng.normal(size=(200, 5)) + 50, np.arange(200) % 4
    y = x[:, 0] - 2 * x[:, 3] + rng.normal(size=200)
    df = spark.createDataFrame([(int(f), a.tolist(), float(b)) for f, a, b in zip(fold, x, y)], "fold int, x array<double>, y double")
    moments = MO.fold_moments(df)
    for alpha, ratio in ((0.01, 0.1), (0.3, 0.9)):
        want = np.mean([r.mse for r in MO.cross_validate(df, [alpha], ratio).collect()])
        assert abs(MO.cross_validated_mse(moments, alpha, ratio) - want) < 1e-6
