"""Distributed ranks, quantiles, MI and metrics against numpy/pandas."""
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.ranking import exact_quantiles, global_rank
from tessera.operators import stats as S


def test_global_rank_matches_row_number(spark):
    df = spark.range(0, 5000).withColumn("g", (F.col("id") % 7).cast("int")) \
              .withColumn("v", F.pmod(F.col("id") * 7919, 1009))
    r = global_rank(df, ["v", "id"], "pos")
    ref = df.withColumn("pos2", F.row_number().over(Window.orderBy("v", "id")))
    assert r.join(ref, "id").filter("pos != pos2").count() == 0
    rg = global_rank(df, ["v", "id"], "pos", partition_by=["g"])
    refg = df.withColumn("pos2", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert rg.join(refg, "id").filter("pos != pos2").count() == 0


def test_global_rank_after_shuffle_is_consistent(spark):
    # input produced by an aggregation (row order after a shuffle is not fixed)
    df = spark.range(0, 3000).groupBy((F.col("id") % 997).alias("k")).agg(F.count("*").alias("c"))
    r = global_rank(df, ["k"], "pos").orderBy("pos").collect()
    assert [x.pos for x in r] == list(range(1, 998)) and [x.k for x in r] == list(range(997))


def test_exact_quantiles_numpy(spark):
    rnd = np.random.default_rng(1)
    vals = rnd.normal(size=301)
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(vals)], "g int, v double")
    q = {r.g: r for r in exact_quantiles(df, "v", [0.25, 0.5, 0.75], ["g"]).collect()}
    for g in range(3):
        sub = vals[np.arange(len(vals)) % 3 == g]
        assert q[g].q25 == pytest.approx(np.quantile(sub, 0.25))
        assert q[g].q50 == pytest.approx(np.quantile(sub, 0.5))
        assert q[g].q75 == pytest.approx(np.quantile(sub, 0.75))


def test_box_and_histogram(spark):
    vals = list(range(1, 21)) + [100.0]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    b = S.box_stats(df, "v").first()
    q1, q3 = np.quantile(vals, [0.25, 0.75])
    assert b.q25 == pytest.approx(q1) and b.q75 == pytest.approx(q3)
    assert b.n_outliers == 1 and b.whisker_hi == 20.0 and b.whisker_lo == 1.0
    h = S.histogram(df, "v", 10).orderBy("bin").collect()
    counts, _ = np.histogram(vals, bins=10)
    got = [0] * 10
    for r in h:
        got[r.bin - 1] = r.n
    assert got == list(counts)


def test_average_rank_and_spearman(spark):
    x = [1, 2, 2, 3, 5, 5, 5, 9]
    y = [2, 1, 4, 3, 6, 5, 7, 8]
    df = spark.createDataFrame(list(zip(map(float, x), map(float, y))), "x double, y double")
    got = S.spearman(df, "x", "y").first().spearman
    exp = pd.Series(x).rank().corr(pd.Series(y).rank())
    assert got == pytest.approx(exp)


def test_mutual_info_binned_matches_numpy(spark):
    rnd = random.Random(2)
    rows, labels = [], {}
    for p in range(200):
        labels[str(p)] = p % 2
        for f in ("a", "b"):
            v = rnd.random() + (0.5 * (p % 2) if f == "a" else 0)
            rows.append((str(p), f, v))
    cells = spark.createDataFrame(rows, "patient_id string, feature string, beta double")
    lab = spark.createDataFrame(list(labels.items()), "patient_id string, y int")
    mi = {r.feature: r.mi for r in S.mutual_info_binned(cells, lab, "patient_id", "feature", "beta", "y").collect()}
    for f in ("a", "b"):
        xs = np.array([v for (_, ff, v) in rows if ff == f])
        ys = np.array([labels[p] for (p, ff, _) in rows if ff == f])
        lo, hi = xs.min(), xs.max()
        xb = np.minimum(np.floor((xs - lo) / (hi - lo) * 10), 9)
        joint = pd.crosstab(xb, ys).to_numpy() / len(xs)
        px, py = joint.sum(1, keepdims=True), joint.sum(0, keepdims=True)
        nz = joint > 0
        exp = float((joint[nz] * np.log(joint[nz] / (px @ py)[nz])).sum())
        assert mi[f] == pytest.approx(exp)
    assert mi["a"] > mi["b"]
    sel = S.select_features(S.mutual_info_binned(cells, lab, "patient_id", "feature", "beta", "y"), 1.0)
    assert [r.feature for r in sel.collect()] == ["a"]


def test_regression_metrics_numpy(spark):
    y = np.array([3.0, 5.0, 2.5, 7.0, 4.0])
    yh = np.array([2.5, 5.5, 2.0, 8.0, 4.0])
    df = spark.createDataFrame(list(zip(y.tolist(), yh.tolist())), "y double, yhat double")
    m = S.regression_metrics(df).first()
    assert m.mae == pytest.approx(np.abs(y - yh).mean())
    assert m.mse == pytest.approx(((y - yh) ** 2).mean())
    assert m.r2 == pytest.approx(1 - ((y - yh) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    f = S.fit_line(df, "y", "yhat").first()
    slope, icpt = np.polyfit(y, yh, 1)
    assert f.slope == pytest.approx(slope) and f.intercept == pytest.approx(icpt)


def test_confusion_zero_denominator(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double")
    c = S.confusion(df, "y", "p", 0.5).first()
    assert (c.tp, c.fp, c.tn, c.fn) == (0, 0, 2, 0)
    assert c.precision == 0.0 and c.recall == 0.0 and c.accuracy == 1.0


def test_class_distribution(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    d = {r.label: r for r in S.class_distribution(df).collect()}
    assert d[1].pct == pytest.approx(25.0) and d[0].n == 3
    assert d[1].log_inv == pytest.approx(math.log(4))


def _psi(n):
    return sum(1.0 / j for j in range(1, int(n))) - 0.5772156649015329


def _knn_mi_bruteforce(x, y, k=3):
    x, y = np.asarray(x, float), np.asarray(y)
    radius, kk, lc = {}, {}, {}
    for lab in np.unique(y):
        idx = np.where(y == lab)[0]
        if len(idx) < 2:
            continue
        kl = min(k, len(idx) - 1)
        for i in idx:
            radius[i] = np.sort(np.abs(x[idx] - x[i]))[kl]
            kk[i], lc[i] = kl, len(idx)
    keep = sorted(radius)
    xs = x[keep]
    m = [int(np.sum((xs > x[i] - radius[i]) & (xs < x[i] + radius[i]))) if radius[i] > 0
         else int(np.sum(xs == x[i])) for i in keep]
    mi = _psi(len(keep)) + np.mean([_psi(kk[i]) for i in keep]) - np.mean([_psi(lc[i]) for i in keep]) \
        - np.mean([_psi(v) for v in m])
    return max(mi, 0.0)


def test_knn_mutual_info_bruteforce(spark):
    rnd = np.random.default_rng(4)
    rows, labs = [], []
    for p in range(120):
        lab = int(p % 3 == 0)
        labs.append((str(p), lab))
        rows.append((str(p), "a", float(np.round(rnd.normal(lab * 1.5, 1.0), 2))))   # ties on purpose
        rows.append((str(p), "b", float(rnd.normal())))
    rows.append(("solo", "a", 0.5))
    labs.append(("solo", 7))                                                         # class seen once
    cells = spark.createDataFrame(rows, "patient_id string, feature string, beta double")
    lab = spark.createDataFrame(labs, "patient_id string, y int")
    got = {r.feature: r.mi for r in S.mutual_info_knn(cells, lab, "patient_id", "feature", "beta", "y").collect()}
    ymap = dict(labs)
    for f in ("a", "b"):
        pts = [(v, ymap[p]) for (p, ff, v) in rows if ff == f]
        exp = _knn_mi_bruteforce([v for v, _ in pts], [c for _, c in pts])
        assert got[f] == pytest.approx(exp, abs=1e-9)
    assert got["a"] > got["b"]


@pytest.mark.parametrize("block_values", [1 << 15, 60, 7])
def test_knn_mutual_info_in_blocks(spark, block_values):
    from tessera.operators.class_neighbours import mutual_info_knn
    rnd = np.random.default_rng(9)
    n = 500
    lab = np.where(rnd.random(n) < 0.03, 2, (rnd.random(n) < 0.4).astype(int))      # a rare class reaches over many blocks
    lab[0] = 9                                                                     # a class seen once
    feats = {"normal": rnd.normal(lab, 1.0), "ties": np.round(rnd.normal(lab, 1.0), 1), "hot": np.where(rnd.random(n) < 0.5, 0.25, rnd.normal(size=n)),
             "constant": np.full(n, 3.0), "skewed": np.exp(4 * rnd.normal(size=n)), "few": rnd.normal(size=n)}
    rows = [(f"p{i}", f, None if i % 17 == 5 else float(v[i])) for f, v in feats.items() for i in range(n if f != "few" else 5)]
    cells = spark.createDataFrame(rows, "pid string, feature string, beta double").repartition(3)
    labels = spark.createDataFrame([(f"p{i}", int(c)) for i, c in enumerate(lab)] + [("none", 1), ("null", None)], "pid string, y int")
    got = {r.feature: r.mi for r in mutual_info_knn(cells, labels, "pid", "feature", "beta", "y", 3, block_values).collect()}
    assert set(got) == set(feats)
    for f, v in feats.items():
        keep = [i for i in range(n if f != "few" else 5) if i % 17 != 5]
        assert got[f] == pytest.approx(_knn_mi_bruteforce([v[i] for i in keep], [lab[i] for i in keep]), abs=1e-9), f
    # rows of a key that come twice: one point at distance 0 from itself
    twice = {r.feature: r.mi for r in mutual_info_knn(cells.unionByName(cells), labels, "pid", "feature", "beta", "y", 3, block_values).collect()}
    keep = [i for i in range(n) if i % 17 != 5]
    known = [i for i in keep if (lab[keep] == lab[i]).sum() * 2 > 1]
    want = _psi(len(known)) + _psi(3) * (1 - 1 / len(known) * (lab[0] == 9)) + _psi(1) / len(known) * (lab[0] == 9) \
        - np.mean([_psi(2 * (lab[keep] == lab[i]).sum()) for i in known]) - _psi(1)
    assert twice["normal"] == pytest.approx(max(0.0, want), abs=1e-9)
    empty = spark.createDataFrame([], cells.schema)
    assert mutual_info_knn(empty, labels, "pid", "feature", "beta", "y", 3, block_values).collect() == []


def test_digamma_int(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 5, 10, 11, 50, 1000)], "n int")
    got = [r.p for r in df.select(S.digamma_int("n").alias("p")).orderBy("n").collect()]
    assert got == pytest.approx([_psi(n) for n in (1, 2, 5, 10, 11, 50, 1000)], abs=1e-12)
