"""Splits, samples, perturbation bounds and replica-count loops."""
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import balance as B
from tessera.operators import sampling as SM
from tessera.operators.search import py_uniform


@pytest.fixture()
def people(spark):
    return spark.createDataFrame([(f"p{i:03d}", i % 3) for i in range(103)], "patient_id string, cls int")


def test_uniform_matches_python(spark):
    from tessera.functions.random import uniform
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    got = [r.u for r in df.select(uniform(42, "k").alias("u")).orderBy("k").collect()]
    assert got == [py_uniform(42, "a"), py_uniform(42, "b")]


def test_split3_sizes_disjoint_exhaustive(people):
    s = SM.split3(people, "patient_id", 0.2, 0.2, seed=1)
    counts = {r.split: r.n for r in s.groupBy("split").agg(F.count("*").alias("n")).collect()}
    n_test = math.ceil(103 * 0.2)
    n_val = math.ceil((103 - n_test) * 0.2)
    assert counts == {"test": n_test, "val": n_val, "train": 103 - n_test - n_val}
    assert s.select("patient_id").distinct().count() == 103
    # seeded: the same split twice
    again = SM.split3(people, "patient_id", 0.2, 0.2, seed=1)
    assert s.join(again, ["patient_id", "split"]).count() == 103


def test_kfold_contiguous(people):
    f = SM.kfold_ids(people, ["patient_id"], 4).orderBy("patient_id").collect()
    sizes = [sum(1 for r in f if r.fold == k) for k in range(4)]
    assert sizes == [26, 26, 26, 25]
    assert [r.fold for r in f] == sorted(r.fold for r in f)


def test_sample_per_class_cap(people):
    s = SM.sample_per_class(people, "cls", "patient_id", k=10)
    assert {r.cls: r.n for r in s.groupBy("cls").agg(F.count("*").alias("n")).collect()} == {0: 10, 1: 10, 2: 10}


def test_sample_half_and_shuffle(people):
    assert SM.sample_half(people, "patient_id").count() == 51
    pos = sorted(r.pos for r in SM.shuffle(people, "patient_id").collect())
    assert pos == list(range(1, 104))


@pytest.mark.parametrize("n,d,u", [(1000, 100, 9), (1000, 300, 3), (1000, 450, 2), (500, 46, 10), (1000, 10, 1)])
def test_minority_replicas(spark, n, d, u):
    df = spark.createDataFrame([(n, d)], "n long, d long")
    assert df.select(B.minority_replicas(F.col("n"), F.col("d")).alias("u")).first().u == u


@pytest.mark.parametrize("n,pos,u", [(1000, 100, 1), (1000, 250, 1), (1000, 400, 1), (1000, 500, 2), (500, 49, 1)])
def test_whole_replicas(spark, n, pos, u):
    half = 100 * pos / (n - 1) > 30
    df = spark.createDataFrame([(n, pos, half)], "n long, c long, h boolean")
    assert df.select(B.whole_replicas(F.col("n"), F.col("c"), F.col("h")).alias("u")).first().u == u


def test_perturb_bounds_and_edges(spark):
    rows = [(f"p{i:02d}", f"f{j}", 1.0) for i in range(25) for j in range(3)]
    cells = spark.createDataFrame(rows, "patient_id string, feature string, beta double")
    pct = 10.0
    out = B.perturb(cells, cells.select("patient_id"), pct, seed=3)
    vals = [r.beta for r in out.collect()]
    lo, hi = (1 - pct / 100) ** 3, (1 + pct / 100) ** 3
    assert all(lo <= v <= hi for v in vals) and len(vals) == 75
    # edge patients (positions round(.1n)..round(.9n)) sit in two slices
    sl = {r.patient_id: len(r._slices) for r in B.slices(cells.select("patient_id")).collect()}
    edges = {round(j / 10 * 25) for j in range(1, 10)}
    for i in range(25):
        assert sl[f"p{i:02d}"] == (2 if i in edges else 1)
    # originals untouched; one factor per (feature, slice)
    assert cells.agg(F.sum("beta")).first()[0] == 75.0


def test_upsample_replicas(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    up = B.upsample(df, df, 3)
    assert sorted(r.replica for r in up.collect()) == [0, 0, 1, 1, 2, 2, 3, 3]
