"""Price-window semantics against direct simulations of the reference loops."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import timeseries as T
from tessera.operators import returns as R


def reference_windows(n, size=275, stride=75, cap=10**9):
    """The reference's while-loop, returning the label-row positions."""
    out, start, end, total = [], 0, 0, 0
    while end + size < n:
        total += 1
        if total > cap:
            break
        end = start + size
        out.append(end)
        start += stride
    return out


def _series(spark, lengths):
    rows = []
    base = dt.date(2000, 1, 3)
    rnd = random.Random(3)
    for tk, n in enumerate(lengths):
        d = base
        for i in range(n):
            d += dt.timedelta(days=rnd.choice([1, 1, 1, 2, 3]))
            rows.append((tk, d, round(10 + rnd.random() * 5, 4)))
    return spark.createDataFrame(rows, "tk long, dt date, px double")


def test_count_windows_closed_form(spark):
    lengths = [100, 275, 276, 350, 550, 551, 626, 700, 1000, 1200]
    s = _series(spark, lengths)
    got = {(r.tk, r.window_no) for r in T.count_windows(s).collect()}
    exp = set()
    for tk, n in enumerate(lengths):
        for k, _ in enumerate(reference_windows(n)):
            exp.add((tk, k))
    assert got == exp


def test_window_points_match_windows(spark):
    s = _series(spark, [700, 400])
    pts = T.window_points(s)
    counts = {(r.tk, r.window_no): r.n for r in pts.groupBy("tk", "window_no").agg(F.count("*").alias("n")).collect()}
    wins = {(r.tk, r.window_no) for r in T.count_windows(s).collect()}
    assert set(counts) == wins and all(v == 275 for v in counts.values())


def test_forward_gain_inclusive(spark):
    rows = [(1, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(p)) for i, p in enumerate([10, 11, 9, 15, 8, 8, 8, 8, 8, 30])]
    s = spark.createDataFrame(rows, "tk long, dt date, px double")
    g = {r.dt.day: r for r in T.forward_gain(s, {"week": 8}).collect()}
    # day 1: max over days 1..9 = 15 -> +50 %; day 2 includes day 10 (= day 2 + 8)
    assert g[1].week_max == 15 and g[1].week_gain == pytest.approx(50.0)
    assert g[2].week_max == 30
    assert all(r.week_gain >= 0 for r in g.values())


@pytest.mark.parametrize("gain,expect", [
    (49.9, ["Month-Underperform"]), (50.0, ["Month50"]), (70.0, ["Month50"]),
    (70.1, ["Month50", "Month70"]), (95.0, ["Month50", "Month70", "Month90"])])
def test_month_ladder(spark, gain, expect):
    df = spark.createDataFrame([(gain,)], "g double")
    got = df.select(T.ladder_labels("g", T.MONTH_RUNGS, "Month").alias("l")).first().l
    assert got == expect


def test_exclusive_bucket(spark):
    df = spark.createDataFrame([(10.0,), (55.0,), (95.0,)], "g double")
    got = [r.b for r in df.select(T.exclusive_bucket("g", T.MONTH_RUNGS, "Month").alias("b")).collect()]
    assert got == ["Month<50", "Month<70", "Month>=90"]


def ref_indicators(prices, w=12):
    """Direct transcription of the indicator semantics sheet (w+1 frames, RSI on w moves);
    prices are numpy scalars, so ``round`` is numpy's scalar rounding."""
    import numpy as np
    prices = [np.float64(p) for p in prices]
    sma, rsi, ema = [], [], []
    prev_ema = None
    a = 2 / (w + 1)
    for i, v in enumerate(prices):
        if i < w:
            sma.append(None); rsi.append(None); ema.append(None)
            continue
        frame = prices[i - w:i + 1]
        m = round(sum(frame) / len(frame), 2)
        sma.append(m)
        prev_ema = round(v * a + (m if prev_ema is None else prev_ema) * (1 - a), 2)
        ema.append(prev_ema)
        ups = [max(prices[j] - prices[j - 1], 0) for j in range(i - w + 1, i + 1)]
        dns = [max(prices[j - 1] - prices[j], 0) for j in range(i - w + 1, i + 1)]
        au, ad = sum(ups) / w, sum(dns) / w
        rsi.append(None if ad == 0 and au == 0 else 100.0 if ad == 0 else round(100 - 100 / (1 + au / ad), 2))
    as_float = lambda xs: [None if x is None else float(x) for x in xs]
    return as_float(sma), as_float(rsi), as_float(ema)


def test_sma_rsi_ema_against_reference(spark):
    rnd = random.Random(5)
    prices = [round(50 + rnd.random() * 10, 3) for _ in range(200)]
    prices[20:33] = [prices[20]] * 13         # a flat stretch: RSI undefined
    rows = [(1, dt.date(2021, 1, 1) + dt.timedelta(days=i), p) for i, p in enumerate(prices)]
    s = spark.createDataFrame(rows, "tk long, dt date, px double")
    sma_ref, rsi_ref, ema_ref = ref_indicators(prices, 12)
    got_sma = [r.sma12 for r in T.sma(s, 12).orderBy("dt").collect()]
    got_rsi = [r.rsi for r in T.rsi(s, 12).orderBy("dt").collect()]
    got_ema = [r.ema12 for r in T.ema(s, (12,)).orderBy("dt").collect()]
    assert got_sma == sma_ref
    assert [None if x is None else round(x, 2) for x in got_rsi] == rsi_ref
    assert [None if x != x else x for x in got_ema] == ema_ref


def test_asof_against_brute_force(spark):
    rnd = random.Random(11)
    right_days = sorted(rnd.sample(range(0, 200), 60))
    base = dt.date(2010, 1, 1)
    right = spark.createDataFrame([(1, base + dt.timedelta(days=d), float(d)) for d in right_days], "tk long, dt date, px double")
    targets = [(1, base + dt.timedelta(days=t)) for t in range(-5, 210, 3)]
    left = spark.createDataFrame(targets, "tk long, target date")
    back = {r.target: r.match_dt for r in T.asof(left, right, "tk", "target", "dt", "backward", 6).collect()}
    fwd = {r.target: r.match_dt for r in T.asof(left, right, "tk", "target", "dt", "forward", 9).collect()}
    days = {base + dt.timedelta(days=d) for d in right_days}
    for _, t in targets:
        bb = [t - dt.timedelta(days=o) for o in range(7) if t - dt.timedelta(days=o) in days]
        ff = [t + dt.timedelta(days=o) for o in range(10) if t + dt.timedelta(days=o) in days]
        assert back[t] == (bb[0] if bb else None)
        assert fwd[t] == (ff[0] if ff else None)


def test_year_prior_return_signs(spark):
    base = dt.date(2001, 1, 1)
    rows = [(1, base + dt.timedelta(days=i), 100.0 + i) for i in range(400)]
    idx = [(base + dt.timedelta(days=i), 1000.0) for i in range(400)]
    s = spark.createDataFrame(rows, "tk long, dt date, px double")
    ix = spark.createDataFrame(idx, "dt date, sp double")
    r = R.year_prior_return(s, ix, [(1, 7), (2, 7)]).first()
    assert r.year_prior_diff > 0 and r.sp_year_prior == 0.0
    assert r.outperformance == pytest.approx(r.year_prior_diff)


def test_unpivot_drops_missing(spark):
    wide = spark.createDataFrame([(dt.date(2020, 1, 1), 1.0, None), (dt.date(2020, 1, 2), 0.0, 2.0)],
                                 "dt date, a double, b double")
    long = T.nonzero_series(T.unpivot_prices(wide))
    assert sorted((r.tk, r.px) for r in long.collect()) == [("a", 1.0), ("b", 2.0)]


def test_window_arrays(spark):
    s = _series(spark, [700])
    arr = {r.window_no: r.prices for r in T.window_arrays(s).collect()}
    px = [r.px for r in s.orderBy("dt").collect()]
    assert sorted(arr) == [0, 1, 2, 3, 4] or sorted(arr) == list(range(len(reference_windows(700))))
    for k, prices in arr.items():
        assert prices == px[75 * k: 75 * k + 275]


def test_labelled_windows_partitioned_sink(spark, tmpdir_path):
    import os
    from tessera.sources.files import write_table
    s = _series(spark, [700, 620])
    lw = T.labelled_windows(s)
    out = os.path.join(tmpdir_path, "graphs")
    write_table(lw, out, partition_by=["bucket"])
    back = spark.read.parquet(out)
    assert back.count() == lw.count() > 0
    assert {d.split("=")[1] for d in os.listdir(out) if d.startswith("bucket=")} == \
        {r.bucket for r in lw.select("bucket").distinct().collect()}
    assert all(len(r.prices) == 275 for r in back.collect())


def test_ema_across_arrow_batches(spark):
    """Series spanning many Arrow batches (7 rows each) fold exactly as in one piece."""
    rnd = random.Random(9)
    rows, ref = [], {}
    for tk in range(3):
        prices = [round(20 + rnd.random() * 5, 3) for _ in range(40 + 13 * tk)]
        ref[tk] = ref_indicators(prices, 12)[2]
        rows += [(tk, dt.date(2022, 1, 1) + dt.timedelta(days=i), p) for i, p in enumerate(prices)]
    s = spark.createDataFrame(rows, "tk long, dt date, px double").repartition(2)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = T.ema(s, (12,)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for tk in range(3):
        series = [r.ema12 for r in sorted((r for r in got if r.tk == tk), key=lambda r: r.dt)]
        assert [None if x != x else x for x in series] == ref[tk]
