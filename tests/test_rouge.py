"""Summary-level ROUGE-L against a plain table, bootstrap intervals against resampling row by row."""

import random

import numpy as np
import pytest

from tessera.operators import rouge as RG


def _positions(ref, pred):
    m, n = len(ref), len(pred)
    t = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            t[i + 1][j + 1] = t[i][j] + 1 if ref[i] == pred[j] else max(t[i][j + 1], t[i + 1][j])
    out, i, j = [], m, n
    while i and j:
        if ref[i - 1] == pred[j - 1]:
            out.insert(0, i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    assert len(out) == t[m][n]
    return out


def test_common_positions_equal_the_plain_table():
    rnd = random.Random(1)
    for _ in range(1000):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        assert RG.common_positions(a, b) == _positions(a, b)


def test_rouge_lsum(spark):
    # union: "a b c d e" holds "a b" and "c d e" of the two predicted sentences
    rows = [(1, "a b x. Y c d e.", "a b c d e"), (2, "the cat sat", "the cat sat. The dog sat"), (3, None, "a b"), (4, "a a a", "a"), (5, "", None),
            (6, "word " * 3000, "word " * 2000)]
    got = {r.id: r for r in RG.rouge_lsum(spark.createDataFrame(rows, "id int, pred string, ref string"), "id", "pred", "ref").collect()}
    assert (got[1].hits, got[1].rougeLsum_p, got[1].rougeLsum_r) == (5, pytest.approx(5 / 7), 1.0)
    assert (got[2].hits, got[2].rougeLsum_p, got[2].rougeLsum_r) == (3, 1.0, 0.5)
    assert (got[4].hits, got[6].hits) == (1, 2000)
    assert all((got[i].rougeLsum_p, got[i].rougeLsum_r, got[i].rougeLsum_f) == (0, 0, 0) for i in (3, 5))


def test_weights_are_poisson_and_independent():
    h = np.random.default_rng(0).integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    w = RG.weights(h, np.arange(300))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs((w == 0).mean() - np.exp(-1)) < 0.005
    corr = np.corrcoef(w)
    assert np.abs(corr - np.eye(300)).max() < 0.1 and np.abs(np.corrcoef(w[:, :200].T) - np.eye(200)).max() < 0.35


def test_bootstrap_equals_row_by_row_and_covers_the_mean(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(3, 2, 900)
    rows = [(i, float(v), float(v) ** 2) for i, v in enumerate(x)] + [(5000, None, 1.0)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")
    runs = [{r.score: r for r in RG.bootstrap_scores(df.repartition(n), "id", ["a", "b"], 400, 0.9, 7).collect()} for n in (1, 6)]
    import hashlib
    h = np.array([int(hashlib.md5(f"7|{i}".encode()).hexdigest()[:16], 16) for i in range(900)], np.uint64)
    w = RG.weights(h, np.arange(400))
    for got in runs:
        for c, v in (("a", x), ("b", x ** 2)):
            want = np.percentile((w @ v) / w.sum(axis=1), [5, 50, 95])
            assert [got[c].low, got[c].mid, got[c].high] == pytest.approx(list(want), abs=1e-12)
    a, half = runs[0]["a"], 1.645 * x.std() / 30
    assert a.low < x.mean() < a.high and a.high - a.low == pytest.approx(2 * half, rel=0.2)
    none = RG.bootstrap_scores(df.filter("id < 0"), "id", ["a"], 10).collect()
    assert [(r.score, r.low, r.mid, r.high) for r in none] == [("a", None, None, None)]
