"""Long beta-matrix operators on ``cells(patient_id, feature, beta)``.

The matrix is never one DataFrame column per feature: analysis and codegen
cost grow with column count, while long cells partition naturally by
patient or feature and keep every aggregate a plain ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import global_rank

PID, FEAT, BETA = "patient_id", "feature", "beta"


def unpack(rows: DataFrame, key: str, vector: str, names: DataFrame | None = None,
           prefix: str = "cg", width: int = 2) -> DataFrame:
    """Packed ``(key, ARRAY<DOUBLE>)`` rows -> long cells.

    Feature names come from ``names(pos, feature)`` when given, else from the
    position (``cg`` + zero-padded index; longer numbers keep all their digits).
    """
    ex = rows.select(F.col(key).cast("string").alias(PID), F.posexplode(vector).alias("pos", "_v"))
    if names is not None:
        ex = ex.join(names, "pos")
    else:
        ex = ex.withColumn(FEAT, F.format_string(f"{prefix}%0{width}d", "pos"))
    return ex.select(PID, FEAT, F.col("_v").cast("double").alias(BETA))


def unpack_chunks(rows: DataFrame, key: str, vector: str, chunk: int) -> DataFrame:
    """Column chunks side by side == the union of their long cells, in one scan whatever the width."""
    chunks = F.expr(f"transform(sequence(0, greatest(size({vector}) - 1, 0), {chunk}), "
                    f"s -> struct(s AS start, slice({vector}, s + 1, {chunk}) AS cells))")
    ex = rows.select(F.col(key).cast("string").alias(PID), F.explode(chunks).alias("_c")) \
        .select(PID, F.col("_c.start").alias("_s"), F.posexplode("_c.cells").alias("_p", "_v"))
    return ex.select(PID, F.format_string("cg%02d", F.col("_s") + F.col("_p")).alias(FEAT), F.col("_v").cast("double").alias(BETA))


def orientation(cells: DataFrame, row_key: str = PID, col_key: str = FEAT) -> DataFrame:
    """Counts of both keys and whether the reference would transpose (columns < rows)."""
    agg = cells.agg(F.count_distinct(row_key).alias("n_rows"), F.count_distinct(col_key).alias("n_cols"))
    return agg.withColumn("transpose", F.col("n_cols") < F.col("n_rows"))


def project(cells: DataFrame, features: DataFrame, feature: str = FEAT, strict: bool = True) -> DataFrame:
    """Keep the cells of listed features (left-semi join; AQE broadcasts a small list).

    A listed feature that the matrix lacks is an error, unless ``strict`` is False."""
    if strict and (absent := missing_features(cells, features, feature).limit(5).collect()):
        raise ValueError("features not in the matrix: " + ", ".join(str(r[0]) for r in absent))
    return cells.join(features.select(feature).distinct(), feature, "left_semi")


def missing_features(cells: DataFrame, features: DataFrame, feature: str = FEAT) -> DataFrame:
    """Listed features absent from the matrix.  Only the names of the matrix are shuffled, each once a task."""
    return features.select(feature).distinct().join(cells.select(feature).distinct(), feature, "left_anti")


def feature_intersect(cells: DataFrame, features: DataFrame, feature: str = FEAT) -> DataFrame:
    """Listed features that the matrix has.  Names are made distinct before they are shuffled: a task gets
    names, whatever the number of cells that carry them."""
    return features.select(feature).distinct().intersect(cells.select(feature).distinct())


def feature_order(cells: DataFrame, feature: str = FEAT) -> DataFrame:
    """Feature dimension with a 0-based position in name order (the packed-array layout)."""
    return global_rank(cells.select(feature).distinct(), [feature], "pos", base=0)


def null_profile(cells: DataFrame, by: str = FEAT, value: str = BETA) -> DataFrame:
    """Per feature: number of cells and of NULL cells (one partial aggregate)."""
    return cells.groupBy(by).agg(F.count(F.lit(1)).alias("n_cells"),
                                 F.count_if(F.col(value).isNull()).alias("n_null"))


def drop_null(cells: DataFrame, axis: str = "rows", value: str = BETA) -> DataFrame:
    """Drop patients (``rows``) or features (``features``) that have any NULL cell.

    The offending keys come from a filtered aggregate (tiny next to the cells),
    then a left-anti join removes them; AQE broadcasts the key set when small.
    """
    key = PID if axis == "rows" else FEAT
    bad = cells.filter(F.col(value).isNull()).select(key).distinct()
    return cells.join(bad, key, "left_anti")


def pack(cells: DataFrame, order: DataFrame, keys: Sequence[str] = (PID,)) -> DataFrame:
    """Long cells -> ``(keys..., x ARRAY<DOUBLE>)`` in ``order.pos`` layout.

    One row per entity, with a slot for every feature of ``order``: an absent cell is
    NULL, so slots never shift.  The array length is the feature count (bounded by the
    feature dimension, never by the number of entities)."""
    n = order.count()
    j = cells.join(order, FEAT)
    packed = j.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", BETA))).alias("_s"))
    by_pos = F.map_from_entries(F.transform("_s", lambda s: F.struct(s["pos"].cast("bigint"), s[BETA])))
    filled = F.transform(F.sequence(F.lit(0), F.lit(max(0, n - 1))), lambda i: F.try_element_at("_m", i.cast("bigint")))
    whole = F.size("_s") == n
    return packed.withColumn("_m", F.when(~whole, by_pos)) \
        .select(*keys, F.when(whole, F.transform("_s", lambda s: s[BETA])).otherwise(filled).alias("x"))
