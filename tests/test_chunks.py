"""Chunk files: damaged ones give no cell and say why; wide lines come in blocks."""

import gzip

import numpy as np
import pytest

from tessera.sources import chunks as C

GOOD = b",cg1,cg2\np1,0.5,NA\np2,x,1\n\np3,2\n"


def test_damaged_files_give_no_cells(spark, tmp_path):
    packed = gzip.compress(GOOD * 1)
    files = {"a.csv": GOOD, "b.csv.gz": packed, "cut.csv.gz": gzip.compress(GOOD + b"p4,0.25,0.75\n" * 5000)[:-20], "long.csv": GOOD + b"p4,1,2,3\n",
             "empty.csv": b"", "bytes.csv": GOOD + b"\xff\xfe\n", "nokey.csv": GOOD + b",1,2\n", "key_only.csv": b"id\np1\n",
             "twice.csv": b",cg1,cg1\np1,1,2\n", "quote.csv": GOOD + b'"p9,1,2\n', "quoted.csv": b'"","cg,1"\n"p ""1""",0.25\n'}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    parsed = C.scan_chunks(spark, str(tmp_path), [*files, "gone.csv"])
    report = {r.path: r for r in C.report_of(parsed).collect()}
    reasons = {n: r.reason for n, r in report.items()}
    assert reasons == {"a.csv": None, "b.csv.gz": None, "quoted.csv": None, "cut.csv.gz": "damaged compression", "long.csv": "row 4: 4 fields, 3 expected",
                       "empty.csv": "no such file, or empty", "bytes.csv": "not utf-8", "nokey.csv": "row 4: no key", "key_only.csv": "no features",
                       "twice.csv": "repeated feature", "quote.csv": reasons["quote.csv"], "gone.csv": "no such file, or empty"}
    assert reasons["quote.csv"].startswith("row 4: ")
    assert tuple(report["a.csv"])[2:] == tuple(report["b.csv.gz"])[2:] == (3, 2, 1) and report["long.csv"].n_rows == 0
    direct = spark.createDataFrame([("e", b""), ("n", None)], "path string, content binary")
    assert [r.reason for r in C.report_of(C.parse_chunks(direct)).collect()] == ["empty file"] * 2
    cells = C.cells_of(parsed).collect()
    assert {r.path for r in cells} == {"a.csv", "b.csv.gz", "quoted.csv"}
    for name in ("a.csv", "b.csv.gz"):
        got = sorted((r.patient_id, r.feature, r.beta) for r in cells if r.path == name)
        assert got == [("p1", "cg1", 0.5), ("p1", "cg2", None), ("p2", "cg1", None), ("p2", "cg2", 1.0), ("p3", "cg1", 2.0), ("p3", "cg2", None)]
    assert [(r.patient_id, r.feature, r.beta) for r in cells if r.path == "quoted.csv"] == [('p "1"', "cg,1", 0.25)]


@pytest.mark.parametrize("width", [1, 10_000, 100_000])
def test_wide_files_equal_their_matrix(spark, width, monkeypatch):
    x = np.random.default_rng(width).random((7, width))
    text = "," + ",".join(f"cg{j}" for j in range(width)) + "\n" + "".join(f"p{i}," + ",".join(map(repr, map(float, r))) + "\n" for i, r in enumerate(x))
    blocks = list(C._parse("utf-8", ",")([C.pa.RecordBatch.from_arrays([C.pa.array(["w.csv"]), C.pa.array([text.encode()])], ["path", "content"])]))
    assert max(b.num_rows for b in blocks) <= C.BLOCK and blocks[-1].column("n_features")[-1].as_py() == width
    got = np.concatenate([b.column("beta").to_numpy(zero_copy_only=False) for b in blocks])[:-1]
    assert (got.reshape(7, width) == x).all()
