"""Hand-worked cases: as-of stops, extraction report, whole-text tokens, ties, strict feature lists."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import extract as E
from tessera.operators import matrix as M
from tessera.operators import ranking as RK
from tessera.operators import returns as R
from tessera.operators import sampling as SM
from tessera.operators import search as SE
from tessera.operators import stats as S
from tessera.operators import text as TO


def _day(s):
    return dt.date.fromisoformat(s)


def _prices(spark, rows):
    return spark.createDataFrame([("A", _day(d), float(p)) for d, p in rows], "tk string, dt date, px double")


def test_forward_samples_stop_before_history(spark):
    # last day 2020-01-31; targets 2020-01-21, 2020-01-01, 2020-01-11 in offset order
    series = _prices(spark, [("2020-01-04", 1), ("2020-01-15", 2), ("2020-01-22", 3), ("2020-01-31", 4)])
    out = R.forward_samples(series, [(1, 10), (2, 30), (3, 20)]).collect()
    # the second lies before the first price: it and the third are not sampled
    assert [(r.b, str(r.match_dt), r.px) for r in out] == [(1, "2020-01-22", 3.0)]


def test_backward_samples_stop_before_history(spark):
    series = _prices(spark, [("2019-01-30", 1), ("2019-02-10", 2), ("2020-01-31", 9)])
    index = series.select("dt", (F.col("px") * 10).alias("sp"))
    # prior date 2019-01-31: z=2 is after it, z=1, 3 and 5 before it
    out = {r.z: r.px for r in R.backward_samples(series, index, [(1, 1), (2, 12), (3, 7), (4, 11), (5, 90)]).collect()}
    # z=1: 01-30; z=2: 02-12 finds 02-10; z=3: 01-24 runs past the first day and stops the rest
    assert out == {1: 1.0, 2: 2.0}


def test_extraction_report(spark):
    page = lambda *cells: "".join(f"<tr><td>{m}</td><td><span>{v}</span></td></tr>\n" for m, v in cells)
    back = lambda *cells: "".join(f"<tr><td>{m}</td><td><b>{v}</b></td>\n" for m, v in cells)
    prim = spark.createDataFrame([("full", page(("Beta", "1.5"), ("Revenue", "2B"))), ("none", page(("Beta", "1.5"))),
                                  ("bad", page(("Beta", "1.5"))), ("miss", page(("Beta", "1.5"))),
                                  ("text", page(("Beta", "1.5"), ("Revenue", "$2B")))], "ticker string, html string")
    backup = spark.createDataFrame([("bad", "not found"), ("miss", back(("Beta", "1"))), ("text", back(("Revenue (ttm)", "3B")))],
                                   "ticker string, html string")
    q = {r.ticker: r for r in E.extract_quality(prim, backup, ["Beta", "Revenue"]).collect()}
    assert q["full"].n_unmatched == 0 and q["full"].error_types == ""
    for t in ("none", "bad"):       # no usable backup: no second report
        assert (q[t].unmatched, q[t].error_types, q[t].backup_unmatched) == ("Revenue", E.NO_MATCH, "")
    assert (q["miss"].backup_unmatched, q["miss"].backup_error_types) == ("Revenue", E.NO_MATCH)
    assert (q["text"].error_types, q["text"].backup_unmatched) == (E.NOT_A_NUMBER, "")
    f = {(r.ticker, r.metric): (r.value, r.source) for r in E.fallback(prim, backup, ["Beta", "Revenue"]).collect()}
    assert f["text", "Revenue"] == (3e9, "backup") and f["full", "Revenue"] == (2e9, "primary")


def test_strict_project(spark):
    cells = spark.createDataFrame([("p", "f1", 1.0)], "patient_id string, feature string, beta double")
    names = spark.createDataFrame([("f1",), ("f2",)], "feature string")
    with pytest.raises(ValueError, match="f2"):
        M.project(cells, names)
    assert M.project(cells, names, strict=False).count() == 1


def _lcs_table(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def test_lcs_against_table():
    rnd = random.Random(5)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(0, 80))] for _ in range(2))
        assert TO._lcs(a, b) == _lcs_table(a, b)


def test_tokenize_whole_text(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{chr(97 + i)}" for i in range(14)), "one two"), (2, "", None)], "id int, text string, ans string")
    rows = TO.tokenize_pad(df, "text", 8, labels_from="ans", label_length=6).orderBy("id", "chunk_no").collect()
    assert [(r.id, r.chunk_no, sum(r.attention_mask)) for r in rows] == [(1, 0, 8), (1, 1, 8), (1, 2, 4), (2, 0, 2)]
    whole = TO.tokenize_pad(df.filter("id = 1"), "text", 64).first()
    body = [i for r in rows[:3] for i, m in zip(r.input_ids, r.attention_mask) if m and i > 2]
    assert body == [i for i in whole.input_ids if i > 2]
    assert [sum(1 for x in r.labels if x > 2) for r in rows] == [2, 0, 0, 0]


def test_mostly_equal_values(spark):
    rnd = random.Random(3)
    vals = [7.0] * 800 + [float(rnd.randrange(50)) for _ in range(200)]
    rnd.shuffle(vals)
    other = [v + rnd.randrange(3) for v in vals]
    df = spark.createDataFrame(list(zip(vals, other)), "x double, y double").repartition(6)
    import numpy as np
    import pandas as pd
    q = RK.exact_quantiles(df, "x", [0.05, 0.25, 0.5, 0.99]).first()
    assert list(q) == pytest.approx([np.quantile(vals, p) for p in (0.05, 0.25, 0.5, 0.99)])
    want = pd.Series(vals).rank().corr(pd.Series(other).rank())
    assert S.spearman(df, "x", "y").first()[0] == pytest.approx(want)
    pos = {r.x: (r.n_rows, r.before) for r in RK.value_positions(df, "x").collect()}
    assert pos == {v: (vals.count(v), sum(w < v for w in vals)) for v in set(vals)}


def test_quantiles_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert RK.exact_quantiles(empty, "x", [0.5], ["g"]).collect() == []
    assert RK.exact_quantiles(empty, "x", [0.5]).first()[0] is None
    assert S.spearman(empty.select("x", F.col("x").alias("y")), "x", "y").first()[0] is None


def test_sample_of_a_hot_class(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2900, "hot").otherwise("cold").alias("c"))
    got = {r.c: r.n for r in SM.sample_per_class(df, "c", "id", 150).groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert got == {"hot": 150, "cold": 100}
    two = SM.two_class_set(df, "c", "id", "hot", "cold", 150, 0.8).collect()
    assert len(two) == 250 and sum(r.split == "train" for r in two) == 200
    assert {(r.c, r.label, r.share) for r in two} == {("hot", 1, 0.6), ("cold", 0, 0.4)}


def test_split_by_entity_ranks_ids_only(spark):
    df = spark.createDataFrame([(f"p{i % 10}", [float(i)]) for i in range(30)], "patient_id string, x array<double>")
    s = SM.split3(df, "patient_id", 0.2, 0.2)
    per = s.groupBy("patient_id").agg(F.count_distinct("split").alias("n"), F.first("split").alias("split")).collect()
    assert all(r.n == 1 for r in per) and sorted(r.split for r in per) == ["test"] * 2 + ["train"] * 6 + ["val"] * 2
    # the checkpointed side of the plan holds ids and positions, no vectors
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    saved = [line for line in plan.splitlines() if "RDD" in line and "__gr_part" in line]
    assert saved and not any("x#" in line for line in saved), plan


def test_thresholds_by_interval(spark):
    rows = [(0.1, 0), (0.4, 1), (0.5, 1), (0.5, 0), (0.9, 1), (float("nan"), 0), (None, 1), (0.9, None)]
    df = spark.createDataFrame(rows, "p double, y int")
    out = {r.trial: (r.tp, r.fp, r.tn, r.fn) for r in SE.evaluate_thresholds(df, SE.param_grid(threshold=[0.5, 0.4, 0.95], weight=[0.5])).collect()}
    assert out == {1: (1, 1, 2, 2), 2: (2, 2, 1, 1), 3: (0, 1, 2, 3)}


def test_trailing_window_against_brute_force(spark):
    from tessera.operators import timeseries as T
    rnd = random.Random(11)
    base = _day("2020-01-01")
    rows = []
    for tk in "AB":
        for d in sorted(rnd.sample(range(200), 90)):
            rows.append((tk, base + dt.timedelta(d), None if rnd.random() < 0.1 else round(rnd.uniform(1, 9), 2)))
    df = spark.createDataFrame(rows, "tk string, dt date, px double").repartition(5)
    got = {(r.tk, r.dt): r for r in T.trailing_window(df, 20).collect()}
    assert len(got) == len(rows)
    for tk, day, _ in rows:
        vals = [p for t, d, p in rows if t == tk and 0 <= (day - d).days <= 20 and p is not None]
        r = got[tk, day]
        assert r.n_days == len(vals) and r.lo == min(vals, default=None) and r.hi == max(vals, default=None)
        assert r["mean"] == (pytest.approx(sum(vals) / len(vals), abs=1e-4) if vals else None)
