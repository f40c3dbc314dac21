"""Wide CSV matrices as rectangular tiles.

A matrix is a file, or a folder of row parts: a header line (its first cell is ``key_header``,
the others name the columns) and one line a row.  A tile holds some rows of one run of
``tile_cols`` columns: ``col_start``, ``n_rows``, ``n_cols``, ``row_keys``, ``col_keys`` and ``values`` row by
row.  Lines are cut into strips of ``tile_cols`` cells inside the scan, and a task keeps at
most ``budget`` cells of them, so no step but the text reader's own line depends on the width.  Names
stand once a column block in a table of their own until a tile takes its block's.

The shape follows from the tiles' numbers (no distinct counts); a transposition turns each
tile where it stands, without a shuffle.

Defined cases: a short line lacks its last cells (null); a longer one than the header is an error, as is a
header that differs from the first or a matrix without one; blank lines are left out; a cell that is no
number is null; fields are not quoted; a file of a header alone has no tiles, hence no shape.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut_lineage, ship_package

TILE_ROWS, TILE_COLS, BUDGET = 256, 1024, 1 << 21
_TILE = "col_start int, n_rows int, n_cols int, row_keys array<string>, values array<double>"


def _tile(start: int, keys: list[str], rows: list[np.ndarray]) -> pa.RecordBatch:
    values = np.concatenate(rows)
    values = pa.array(values, pa.float64(), mask=np.isnan(values))
    one = [pa.array([v], pa.int32()) for v in (start, len(keys), len(rows[0]))]
    return pa.RecordBatch.from_arrays([*one, pa.array([keys], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)],
                                      ["col_start", "n_rows", "n_cols", "row_keys", "values"])


def _gather(tile_rows: int, budget: int):
    """Strips (key, col_start, values) to tiles: a block that is full goes out, and all go when the budget is used."""
    def run(batches):
        open_tiles: dict[int, tuple[list, list]] = {}
        held = 0
        for batch in batches:
            strips = batch.column(2)
            ends = strips.offsets.to_numpy()
            numbers = strips.values.to_numpy(zero_copy_only=False).astype(float)
            for i, (key, start) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                keys, rows = open_tiles.setdefault(start, ([], []))
                keys.append(key)
                rows.append(numbers[ends[i]:ends[i + 1]].copy())
                held += len(rows[-1])
                if len(keys) == tile_rows:
                    held -= sum(map(len, rows))
                    yield _tile(start, *open_tiles.pop(start))
                elif held >= budget:
                    for s in list(open_tiles):
                        yield _tile(s, *open_tiles.pop(s))
                    held = 0
        for s, (keys, rows) in open_tiles.items():
            yield _tile(s, keys, rows)
    return run


def read_tiles(spark: SparkSession, path, key_header: str = "", sep: str = ",", tile_rows: int = TILE_ROWS,
               tile_cols: int = TILE_COLS, budget: int = BUDGET) -> DataFrame:
    """Tiles of the matrix at ``path``.  The header's width and hash are read first (the scan stops there);
    the lines are read once when the tiles are.  Write them (Parquet) where they are used more than once:
    ``shape`` then reads three numbers a tile."""
    ship_package(spark)
    lines = spark.read.option("ignoreCorruptFiles", False).text(path).filter(F.length("value") > 0).withColumn("cells", F.split("value", sep, -1))
    header = F.trim(F.col("cells")[0]) == key_header
    first = lines.filter(header).select(F.size("cells") - 1, F.xxhash64("value"), "value").first()
    if first is None:
        raise ValueError(f"no header line in {path}")
    width, mark = first[0], first[1]
    if not width:
        raise ValueError(f"no columns in {path}")

    def strips(pad):
        """(start, cells) of each column block; what a short line lacks is null."""
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(width - 1), F.lit(tile_cols)), lambda s: F.struct(
            s.alias("col_start"), pad(F.slice("cells", s + 2, tile_cols), F.least(F.lit(tile_cols), F.lit(width) - s)).alias("part"))))

    names = cut_lineage(lines.filter(header).limit(1).select(strips(lambda part, n: part).alias("s")).select("s.col_start", F.col("s.part").alias("col_keys")))
    lines = lines.withColumn("cells", F.when(header & (F.xxhash64("value") != mark), F.raise_error(F.lit("headers differ")))
                             .when(F.size("cells") > width + 1, F.raise_error(F.concat(F.lit("more cells than the header: row "), F.col("cells")[0]))).otherwise(F.col("cells")))
    numbers = strips(lambda part, n: F.concat(F.transform(part, lambda c: F.trim(c).try_cast("double")),
                                              F.array_repeat(F.lit(None).cast("double"), n - F.size(part))))
    cut = lines.filter(~header | (F.xxhash64("value") != mark)).select(F.col("cells")[0].alias("key"), numbers.alias("s"))
    tiles = cut.select("key", "s.col_start", "s.part").mapInArrow(_gather(tile_rows, budget), _TILE)
    return tiles.join(names, "col_start").select("col_start", "n_rows", "n_cols", "row_keys", "col_keys", "values")


def shape(tiles: DataFrame) -> DataFrame:
    """``n_rows``, ``n_cols`` and ``transpose`` (fewer columns than rows) from the tiles' own numbers."""
    out = tiles.agg(F.sum(F.when(F.col("col_start") == 0, F.col("n_rows"))).cast("bigint").alias("n_rows"),
                    F.max(F.col("col_start") + F.col("n_cols")).cast("bigint").alias("n_cols"))
    return out.withColumn("transpose", F.col("n_cols") < F.col("n_rows"))


def _turn(batches):
    for batch in batches:
        rows, cols = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        values = batch.column(5)
        flat, ends = values.values, values.offsets.to_numpy()
        order = np.concatenate([np.arange(a, b).reshape(r, c).T.ravel() for a, b, r, c in zip(ends, ends[1:], rows, cols)]) if len(rows) else np.zeros(0, int)
        turned = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), flat.take(pa.array(order)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), batch.column(4), batch.column(3), turned],
                                         ["row_start", "n_rows", "n_cols", "row_keys", "col_keys", "values"])


def transpose(tiles: DataFrame) -> DataFrame:
    """Rows become columns, tile by tile; ``row_start`` takes the place of ``col_start``."""
    ship_package(tiles.sparkSession)
    return tiles.select("col_start", "n_rows", "n_cols", "row_keys", "col_keys", "values").mapInArrow(
        _turn, "row_start int, n_rows int, n_cols int, row_keys array<string>, col_keys array<string>, values array<double>")


def orient(tiles: DataFrame) -> DataFrame:
    """Tiles with as many columns as rows or more: transposed where there are fewer (two numbers are read)."""
    return transpose(tiles) if shape(tiles).first()["transpose"] else tiles


def column_nulls(tiles: DataFrame) -> DataFrame:
    """``col_key``, ``n_cells``, ``n_null`` of each column of tiles: a partial sum per tile before any shuffle."""
    c, w = F.col, F.col("n_cols")
    missing = F.transform(F.sequence(F.lit(0), w - 1), lambda j: F.struct(
        c("col_keys")[j].alias("col_key"), c("n_rows").cast("bigint").alias("n"),
        F.aggregate(F.sequence(F.lit(0), c("n_rows") - 1), F.lit(0).cast("bigint"), lambda s, i: s + F.isnull(c("values")[i * w + j]).cast("bigint")).alias("m")))
    return tiles.select(F.inline(missing)).groupBy("col_key").agg(F.sum("n").alias("n_cells"), F.sum("m").alias("n_null"))


def cells(tiles: DataFrame, row: str = "patient_id", col: str = "feature", value: str = "beta") -> DataFrame:
    """Long cells of tiles."""
    w = F.col("n_cols")
    each = F.transform(F.sequence(F.lit(0), F.size("values") - 1), lambda i: F.struct(
        F.col("row_keys")[(i / w).cast("int")].alias(row), F.col("col_keys")[F.pmod(i, w)].alias(col), F.col("values")[i].alias(value)))
    return tiles.select(F.inline(each))
