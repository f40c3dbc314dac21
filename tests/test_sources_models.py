"""File sources/sinks round trips, model parity and persistence, the driver contract."""
import json
import os

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import models as MD
from tessera.sources import files as SRC

from conftest import SF001


def test_csv_encoding_roundtrip(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "meta.csv")
    with open(p, "w", encoding="cp1252") as fh:
        fh.write(",Endocrine Disease\nP1,Diabète type 2\nP2,\n")
    df = SRC.read_table(spark, p, "_c0 string, `Endocrine Disease` string", encoding="windows-1252", key="patient_id")
    rows = {r.patient_id: r["Endocrine Disease"] for r in df.collect()}
    assert rows == {"P1": "Diabète type 2", "P2": None}
    out = os.path.join(tmpdir_path, "out")
    SRC.write_table(df, out, fmt="csv")
    assert spark.read.option("header", True).csv(out).count() == 2


def test_read_matrix_orientations_and_chunks(spark, tmpdir_path):
    a = os.path.join(tmpdir_path, "chunk_a.csv")
    b = os.path.join(tmpdir_path, "chunk_b.csv")
    with open(a, "w") as fh:
        fh.write(",cg1,cg2\nP1,0.1,0.2\nP2,0.3,\n")
    with open(b, "w") as fh:
        fh.write(",cg3\nP1,0.5\nP2,0.6\n")
    cells, bad = SRC.read_chunks(spark, [a, b, os.path.join(tmpdir_path, "missing.csv")])
    got = {(r.patient_id, r.feature): r.beta for r in cells.collect()}
    assert got == {("P1", "cg1"): 0.1, ("P1", "cg2"): 0.2, ("P2", "cg1"): 0.3, ("P2", "cg2"): None,
                   ("P1", "cg3"): 0.5, ("P2", "cg3"): 0.6}
    assert bad == [os.path.join(tmpdir_path, "missing.csv")]
    t = SRC.read_matrix(spark, a, rows_are="features")
    assert {(r.patient_id, r.feature) for r in t.collect()} >= {("cg1", "P1"), ("cg2", "P2")}


def test_html_and_image_catalog(spark, tmpdir_path):
    for kind in ("info", "backup"):
        os.makedirs(os.path.join(tmpdir_path, kind))
    for t in ("AAA", "BBB"):
        with open(os.path.join(tmpdir_path, "info", f"{t}.html"), "w") as fh:
            fh.write(f"<html>{t}\nline2</html>")
    with open(os.path.join(tmpdir_path, "backup", "AAA.html"), "w") as fh:
        fh.write("<html>b</html>")
    cat = SRC.html_catalog(spark, {"info": os.path.join(tmpdir_path, "info"),
                                   "backup": os.path.join(tmpdir_path, "backup"),
                                   "type": os.path.join(tmpdir_path, "nope")})
    got = sorted((r.ticker, r.kind) for r in cat.collect())
    assert got == [("AAA", "backup"), ("AAA", "info"), ("BBB", "info")]
    assert any("line2" in r.html for r in cat.collect())
    img = os.path.join(tmpdir_path, "imgs")
    for cls in ("Week20", "Month50"):
        os.makedirs(os.path.join(img, cls))
    for name in ("Week20/a.PNG", "Week20/b.jpeg", "Month50/c.jpg", "Month50/notes.txt"):
        with open(os.path.join(img, name), "wb") as fh:
            fh.write(b"\x89PNG")
    ic = SRC.image_catalog(spark, img)
    assert sorted(r["class"] for r in ic.collect()) == ["Month50", "Week20", "Week20"]


def test_json_feed_and_partitioned_sink(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "feed.json")
    with open(p, "w") as fh:
        fh.write(json.dumps({"articles": [{"title": "A", "content": "x"}, {"title": "B", "content": ""}]}) + "\n")
    arts = SRC.read_feed(spark, p)
    assert sorted(r.title for r in arts.collect()) == ["A", "B"]
    out = os.path.join(tmpdir_path, "buckets")
    df = spark.createDataFrame([("AAA", "Week20", [1.0, 2.0]), ("BBB", "Month50", [3.0])],
                               "tk string, bucket string, prices array<double>")
    SRC.write_table(df, out, partition_by=["bucket"])
    assert {"bucket=Month50", "bucket=Week20"} <= set(os.listdir(out))
    assert spark.read.parquet(out).count() == 2


def _enet_cd(X, y, alpha, l1_ratio, iters=5000):
    """scikit-learn objective by coordinate descent (intercept unpenalised)."""
    n, p = X.shape
    xm, ym = X.mean(0), y.mean()
    Xc, yc = X - xm, y - ym
    w = np.zeros(p)
    norms = (Xc ** 2).sum(0) / n
    for _ in range(iters):
        for j in range(p):
            r = yc - Xc @ w + Xc[:, j] * w[j]
            rho = Xc[:, j] @ r / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0) / (norms[j] + alpha * (1 - l1_ratio))
    return w, ym - xm @ w


def test_elastic_net_parity(spark):
    rnd = np.random.default_rng(0)
    X = rnd.normal(size=(200, 4))
    y = 3 * X[:, 0] - 2 * X[:, 1] + 0.5 * X[:, 2] + rnd.normal(scale=0.5, size=200) + 10
    df = spark.createDataFrame([(X[i].tolist(), float(y[i])) for i in range(200)], "x array<double>, y double") \
              .select(array_to_vector("x").alias("features"), "y")
    m = MD.ElasticNet(alpha=0.4, l1_ratio=0.5).fit(df)
    w, b = _enet_cd(X, y, 0.4, 0.5)
    assert np.allclose(m.coefficients, w, atol=1e-4)
    assert m.intercept == pytest.approx(b, abs=1e-4)


def test_model_persistence(spark, tmpdir_path):
    docs = spark.createDataFrame([("good great fine", 1.0), ("bad awful poor", 0.0)] * 10, "text string, label double")
    model = MD.sentiment_pipeline().fit(docs)
    path = os.path.join(tmpdir_path, "model")
    MD.save_model(model, path)
    again = MD.load_model(path)
    a = [r.prediction for r in model.transform(docs).collect()]
    b = [r.prediction for r in again.transform(docs).collect()]
    assert a == b


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 100
