"""Smaller operators: orientation rule, catalogue keys, search draws, folds, fixtures."""
import math
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tessera.operators import extract as E
from tessera.operators import sampling as SM
from tessera.operators import search as SE
from tessera.operators import timeseries as T
from tessera.plans import fixtures as X
from tessera.sources import files as SRC


def test_read_matrix_auto_orientation(spark, tmpdir_path):
    # 2 CpG rows x 3 patient columns: fewer columns than rows is false -> keep; transpose
    # happens when columns < rows (feature rows, patient columns)
    p = os.path.join(tmpdir_path, "m.csv")
    with open(p, "w") as fh:
        fh.write(",P1,P2\ncg1,0.1,0.2\ncg2,0.3,0.4\ncg3,0.5,0.6\n")
    cells = SRC.read_matrix(spark, p, rows_are="auto")
    assert {r.patient_id for r in cells.collect()} == {"P1", "P2"}
    assert cells.count() == 6


@pytest.mark.parametrize("path,key", [
    ("/data/New Company Info/AAPL.html", "AAPL"),
    ("http://x.example.com/fr/825?page=2&ref=x", "825"),
    ("file:/tmp/BRK.B.html", "BRK.B"),
])
def test_catalog_key(spark, path, key):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(E.catalog_key("p").alias("k")).first().k == key


def test_param_random_space():
    trials = SE.param_random({"lr": ("uniform", 0.0001, 0.01), "patience": ("quniform", 8, 15, 1)}, 200, seed=1)
    assert len(trials) == 200
    assert all(0.0001 <= t["lr"] < 0.01 for t in trials)
    assert all(8 <= t["patience"] <= 15 and float(t["patience"]).is_integer() for t in trials)
    assert SE.param_random({"lr": ("uniform", 0, 1)}, 3, seed=1) == SE.param_random({"lr": ("uniform", 0, 1)}, 3, seed=1)


def test_param_grid_order():
    g = SE.param_grid(min_lr=[0.001, 0.0001], noise=[0.1, 0.005, 0.01], dropout=[0.4, 0.5])
    assert len(g) == 12 and g[0] == {"trial": 1, "min_lr": 0.001, "noise": 0.1, "dropout": 0.4}


@pytest.mark.parametrize("n,k", [(3, 4), (10, 4), (12, 4)])
def test_kfold_sizes(spark, n, k):
    df = spark.createDataFrame([(i,) for i in range(n)], "id int")
    f = SM.kfold_ids(df, ["id"], k)
    sizes = {r.fold: r.c for r in f.groupBy("fold").agg(F.count("*").alias("c")).collect()}
    base, extra = divmod(n, k)
    exp = {i: base + (1 if i < extra else 0) for i in range(k) if base + (1 if i < extra else 0) > 0}
    assert sizes == exp


def test_prices_wide_roundtrip(spark):
    wide = X.prices_wide(spark, SF001)
    assert wide.columns[:3] == ["dt", "n00", "n01"] and len(wide.columns) == 26
    long = T.unpivot_prices(wide)
    # every (nation, day) cell with trades comes back exactly once
    assert long.count() == long.select("dt", "tk").distinct().count()


def test_forward_labels_flagship_counts(spark):
    # anchors from FIXTURES.md: 11 window rows and 10 tickers at sf0.001
    w = T.forward_labels(X.series(spark, SF001))
    assert w.count() == 11 and w.select("tk").distinct().count() == 10


def test_cluster_conf_sizes_partitions():
    from tessera.session import cluster_conf
    c = cluster_conf(100 * (1 << 40), 8000)            # 100 TB on 8000 cores
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * (1 << 40) // (256 << 20)
    assert cluster_conf(1 << 20, 8)["spark.sql.shuffle.partitions"] == "16"


def test_label_rules(spark):
    from tessera.operators import labels as L
    df = spark.createDataFrame([("Healthy",), ("LUNG",), ("heme",), (None,), ("Lung; High Blood Pressure",)], "c string")
    got = [(r.a, r.l, r.h, r.cs, r.ci) for r in df.select(
        L.label_exact("c", "any").alias("a"), L.label_exact("c", "lung").alias("l"), L.label_exact("c", "heme").alias("h"),
        L.label_contains("c", "Lung", case=True).alias("cs"), L.label_contains("c", "lung", case=False).alias("ci")).collect()]
    # a missing clinic reads as the text "nan": not healthy -> 1 for 'any', 0 otherwise
    assert got == [(0, 0, 0, 0, 0), (1, 1, 0, 0, 1), (1, 0, 1, 0, 0), (1, 0, 0, 0, 0), (1, 0, 0, 1, 1)]


def test_range_bucket_bounds(spark):
    from tessera.operators import labels as L
    df = spark.createDataFrame([(0.5,), (0.78,), (0.9,), (1.02,), (1.5,), (None,)], "v double")
    got = [r.b for r in df.select(L.range_bucket("v", 0.78, 1.02).alias("b")).collect()]
    assert got == ["healthy", None, "average", None, "below", None]


def test_normalize_and_missing(spark):
    from tessera.operators import labels as L
    cells = spark.createDataFrame([("1", "cg00", 0.1)], "patient_id string, feature string, beta double")
    labels = spark.createDataFrame([("1", 1), ("2", 0)], "patient_id string, label int")
    assert [r.patient_id for r in L.missing(labels, cells).collect()] == ["2"]
    ids = spark.createDataFrame([("X123",)], "i string")
    assert ids.select(L.normalize_id("i").alias("o")).first().o == "123"


def test_feature_names_keep_all_digits_and_slots_never_shift(spark):
    from tessera.operators import matrix as M
    rows = spark.createDataFrame([("p", [float(i) for i in range(120)])], "k string, v array<double>")
    cells = M.unpack(rows, "k", "v")
    assert cells.select("feature").distinct().count() == 120
    assert sorted(map(tuple, M.unpack_chunks(rows, "k", "v", 16).collect())) == sorted(map(tuple, cells.collect()))
    order = spark.createDataFrame([("f1", 0), ("f2", 1)], "feature string, pos bigint")
    two = spark.createDataFrame([("a", "f1", 1.0), ("a", "f2", 2.0), ("b", "f2", 9.0)], "patient_id string, feature string, beta double")
    assert {r.patient_id: r.x for r in M.pack(two, order).collect()} == {"a": [1.0, 2.0], "b": [None, 9.0]}


def test_damaged_chunk_is_reported_and_gives_no_cells(spark, tmpdir_path):
    import gzip
    import os
    text = "," + ",".join(f"f{i}" for i in range(50)) + "\n" + "".join(f"p{i}," + ",".join(str((i * 7919 + j) % 1013 / 1013) for j in range(50)) + "\n" for i in range(400))
    good, bad = os.path.join(tmpdir_path, "a.csv.gz"), os.path.join(tmpdir_path, "b.csv.gz")
    data = gzip.compress(text.encode())
    open(good, "wb").write(data)
    open(bad, "wb").write(data[:len(data) // 2])
    from tessera.sources.files import read_chunks
    cells, unreadable = read_chunks(spark, [good, bad, os.path.join(tmpdir_path, "none.csv")])
    assert unreadable == [bad, os.path.join(tmpdir_path, "none.csv")] and cells.count() == 400 * 50


def test_feature_names_are_distinct_before_they_are_shuffled(spark):
    from tessera.operators import matrix as M
    cells = spark.range(6000).selectExpr("cast(id % 400 as string) patient_id", "if(id % 15 = 0, null, concat('cg', id % 15)) feature", "rand() beta")
    listed = spark.createDataFrame([("cg3",), ("cg3",), (None,), ("absent",)], "feature string")
    both, missing = M.feature_intersect(cells, listed), M.missing_features(cells, listed)
    assert sorted(r[0] or "" for r in both.collect()) == ["", "cg3"] and {r[0] for r in missing.collect()} == {"absent", None}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (M.feature_intersect(cells, listed), M.missing_features(cells, listed)):
            lines = [x.strip(" +-:*()0123456789") for x in df._jdf.queryExecution().sparkPlan().toString().splitlines()]
            at = next(i for i, x in enumerate(lines) if "Join" in x)
            assert sum("HashAggregate" in x for x in lines[at:]) == 4, lines      # both sides, in the task and after
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
