"""k-NN mutual information with a continuous target against all distances, ties included."""

import math

import numpy as np
import pytest

from tessera.operators.neighbours import mutual_info_knn_target, nearest_distances


def _psi(n):
    return -0.5772156649015329 + sum(1 / j for j in range(1, int(n)))


def brute(x, y, unit_y, k):
    n = len(x)
    if n < 2:
        return 0.0
    x, y = x / (x.std() or 1.0), y / unit_y
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    k = min(k, n - 1)
    r = np.sort(d, axis=1)[:, k - 1][:, None]
    count = lambda a: np.where(r > 0, a < r, a == 0).sum(axis=1)
    return max(0.0, _psi(n) + _psi(k) - np.mean([_psi(a) + _psi(b) for a, b in zip(count(dx), count(dy))]))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    n = 700
    y = np.round(rng.normal(size=n), 2) * 4
    y[rng.random(n) < 0.3] = 0.0                                  # a hot target
    feats = {"linear": y + rng.normal(size=n), "noise": rng.normal(size=n), "ties": np.round(y / 4 + rng.normal(size=n), 0), "constant": np.full(n, 2.0),
             "skewed": np.exp(3 * rng.normal(size=n)), "two": np.where(rng.random(n) < 0.4, 1.0, y), "square": y * y, "one": y, "pair": y, "four": y}
    cells, kept = [], {}
    for f, x in feats.items():
        last = {"one": 1, "pair": 2, "four": 3}.get(f, n)
        for i in range(n):
            cells.append((f"p{i}", f, float(x[i]) if i < last and i % 50 != 7 else (None if i % 2 else float("nan"))))
        kept[f] = [i for i in range(n) if i < last and i % 50 != 7 and i % 41 != 3]
    target = [(f"p{i}", None if i % 41 == 3 else float(y[i])) for i in range(n)] + [("nobody", 1.0), ("nan", float("nan"))]
    unit = np.std([t for _, t in target if t is not None and not math.isnan(t)])
    return cells, target, {f: brute(feats[f][i], y[i], unit, 3) for f, i in kept.items()}


@pytest.mark.parametrize("cell_points,block_values,chunk", [(1024, 4096, 1 << 16), (40, 16, 1 << 16), (90, 50, 25)])
def test_equals_all_distances(spark, rows, cell_points, block_values, chunk):
    cells, target, want = rows
    got = mutual_info_knn_target(spark.createDataFrame(cells, "pid string, feature string, beta double").repartition(3),
                                 spark.createDataFrame(target, "pid string, y double"), "pid", "feature", "beta", "y", 3, cell_points, block_values, chunk)
    got = {r.feature: r.mi for r in got.collect()}
    assert set(got) == set(want)
    for f, v in want.items():
        assert abs(got[f] - v) < 1e-9, (f, got[f], v)
    assert got["linear"] > 0.3 > got["noise"] and got["one"] == 0.0


def test_empty(spark):
    none = mutual_info_knn_target(spark.createDataFrame([], "pid string, feature string, beta double"),
                                  spark.createDataFrame([], "pid string, y double"), "pid", "feature", "beta", "y")
    assert none.collect() == []


def test_nearest_distances_count_weights_and_hidden_own_points():
    x, y, w = np.array([0.0, 0.0, 0.0, 1.0, 5.0]), np.array([0.0, 0.0, 0.0, 0.0, 0.0]), np.array([1, 1, 1, 2, 1])
    d = nearest_distances(x, y, w, x, y, np.arange(5), 2)
    assert d.tolist() == [[0, 0], [0, 0], [0, 0], [0, 1], [4, 4]]
    assert nearest_distances(x, y, w, np.array([1.0]), np.array([3.0]), np.array([-1]), 3).tolist() == [[3, 3, 3]]


@pytest.mark.parametrize("kind", ["plain", "rounded", "constant", "skewed"])
def test_nearest_distances_of_many_points(kind):
    rng = np.random.default_rng(3)
    x, y, w = rng.normal(size=900), rng.normal(size=900), rng.integers(1, 4, 900)
    x, y = {"plain": (x, y), "rounded": (np.round(x, 1), np.round(y, 1)), "constant": (np.ones(900), y), "skewed": (np.exp(4 * x), np.where(x > 0, 0, y))}[kind]
    d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))

    def want(d, w):
        return np.array([np.sort(np.repeat(row, np.minimum(weight, 3)))[:3] for row, weight in zip(d, w)])
    assert (nearest_distances(x, y, w, x, y, np.arange(900), 3) == want(d, w - np.eye(900, dtype=int))).all()
    others, within = want(d, np.tile(w, (900, 1))), np.abs(rng.normal(size=900)) / 9
    got = nearest_distances(x, y, w, x, y, np.full(900, -1), 3, within)
    assert (got == np.where(others < within[:, None], others, np.inf)).all()


def test_points_are_dealt_few_times(spark):
    """Shuffles and checkpoints of all points were most of the time: 155 stages without, and more with several strips."""
    rng = np.random.default_rng(4)
    cells = spark.createDataFrame([(i, f, float(v)) for f in "ab" for i, v in enumerate(rng.normal(size=300))], "pid int, feature string, beta double")
    target = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(size=300))], "pid int, y double")
    sc, stages = spark.sparkContext, []
    for points in (1 << 16, 64):
        sc.setJobGroup(f"neighbours-{points}", "")
        mutual_info_knn_target(cells, target, "pid", "feature", "beta", "y", 3, points, points).collect()
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(f"neighbours-{points}")]
        stages.append(len({s for j in jobs for s in j.stageIds}))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert stages[0] < 60 and stages[1] < 200, stages


def test_same_result_in_any_order_and_cut(spark):
    """Equal distances hang on the last bit of a standard deviation."""
    rng = np.random.default_rng(6)
    y = np.round(rng.normal(size=400), 2) * 4
    x = np.where(rng.random(400) < 0.4, 1.0, y)
    target = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "pid int, y double")
    found = set()
    for points, order in ((1 << 16, np.arange(400)), (50, rng.permutation(400)), (90, rng.permutation(400))):
        cells = spark.createDataFrame([(int(i), "f", float(x[i])) for i in order], "pid int, feature string, beta double").repartition(5)
        found.add(round(mutual_info_knn_target(cells, target.orderBy("y"), "pid", "feature", "beta", "y", 3, points, points).first().mi, 12))
    assert len(found) == 1
    assert abs(found.pop() - brute(x, y, y.std(), 3)) < 1e-9
