"""Tiles of wide matrices: any split into tiles gives the matrix, its transpose and its shape."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tessera.sources import tiles as TL


def _write(folder, x, parts, header=True):
    names = "," + ",".join(f"c{j}" for j in range(x.shape[1]))
    for k, rows in enumerate(np.array_split(np.arange(len(x)), parts)):
        lines = [f"r{i}," + ",".join("" if np.isnan(v) else repr(float(v)) for v in x[i]) for i in rows]
        (folder / f"part{k}.csv").write_text("\n".join([names] * (header or k == 0) + lines) + "\n")


def _matrix(rows, x, swap=False):
    got = np.full(x.shape, np.nan)
    seen = np.zeros(x.shape, int)
    for r in rows:
        a, b = (r.feature, r.patient_id) if swap else (r.patient_id, r.feature)
        i, j = int(a[1:]), int(b[1:])
        seen[i, j] += 1
        got[i, j] = np.nan if r.beta is None else r.beta
    assert (seen == 1).all()
    return got


@pytest.mark.parametrize("rows, cols, parts, tile_rows, tile_cols, budget", [
    (7, 5, 1, 256, 1024, 1 << 21), (9, 10, 3, 2, 3, 1 << 21), (6, 7, 2, 256, 2, 5), (1, 1, 1, 1, 1, 1), (5, 23, 2, 3, 23, 30)])
def test_tiles_equal_the_matrix(spark, tmp_path, rows, cols, parts, tile_rows, tile_cols, budget):
    x = np.random.default_rng(rows * cols).normal(size=(rows, cols))
    x[x > 1] = np.nan
    _write(tmp_path, x, parts, header=parts != 2)
    t = TL.read_tiles(spark, str(tmp_path), tile_rows=tile_rows, tile_cols=tile_cols, budget=budget)
    assert all(len(r["values"]) == r.n_rows * r.n_cols and r.n_rows == len(r.row_keys) <= tile_rows and r.n_cols == len(r.col_keys) <= tile_cols for r in t.collect())
    np.testing.assert_array_equal(_matrix(TL.cells(t).collect(), x), x)
    np.testing.assert_array_equal(_matrix(TL.cells(TL.transpose(t)).collect(), x, swap=True), x)
    assert tuple(TL.shape(t).first()) == (rows, cols, cols < rows)
    assert {r.col_key: (r.n_cells, r.n_null) for r in TL.column_nulls(t).collect()} == {f"c{j}": (rows, np.isnan(x[:, j]).sum()) for j in range(cols)}
    turned = TL.orient(t)
    assert ("row_start" in turned.columns) == (cols < rows)


def test_short_long_and_odd_lines(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text(",a,b,c\nr1,1\n\nr2,x, 2 ,NaN\nr1,4,5,6\n")
    t = TL.read_tiles(spark, str(good), tile_cols=2)
    assert sorted((r.patient_id, r.feature, r.beta) for r in TL.cells(t).collect() if r.beta is not None) == [
        ("r1", "a", 1.0), ("r1", "a", 4.0), ("r1", "b", 5.0), ("r1", "c", 6.0), ("r2", "b", 2.0)]
    assert TL.cells(t).count() == 9 and tuple(TL.shape(t).first()) == (3, 3, False)
    (tmp_path / "long.csv").write_text(",a\nr1,1,2\n")
    with pytest.raises(PySparkException, match="more cells than the header: row r1"):
        TL.read_tiles(spark, str(tmp_path / "long.csv")).collect()
    (tmp_path / "two.csv").write_text(",a\nr1,1\n,b\nr2,1\n")
    with pytest.raises(PySparkException, match="headers differ"):
        TL.read_tiles(spark, str(tmp_path / "two.csv")).collect()
    (tmp_path / "none.csv").write_text("r1,1\n")
    with pytest.raises(ValueError, match="no header"):
        TL.read_tiles(spark, str(tmp_path / "none.csv"))
    (tmp_path / "only.csv").write_text(",a,b\n")
    assert TL.read_tiles(spark, str(tmp_path / "only.csv")).collect() == []


def test_a_task_holds_its_budget_whatever_the_width():
    wide = 50_000
    def batches():
        for i in range(40):
            starts = list(range(0, wide, 1000))
            values = TL.pa.ListArray.from_arrays(TL.pa.array(range(0, wide + 1, 1000), TL.pa.int32()), TL.pa.array(np.full(wide, float(i))))
            yield TL.pa.RecordBatch.from_arrays([TL.pa.array([f"r{i}"] * len(starts)), TL.pa.array(starts), values], ["key", "col_start", "part"])
    tiles = list(TL._gather(256, 100_000)(batches()))
    assert sum(len(t.column("values")[0]) for t in tiles) == 40 * wide and max(t.column("n_rows")[0].as_py() for t in tiles) <= 3
