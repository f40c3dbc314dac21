"""Standardisation fitted on the training split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEAT, BETA = "feature", "beta"


def scaler_fit(train_cells: DataFrame, feature: str = FEAT, value: str = BETA) -> DataFrame:
    """Per-feature mean and population std (one partial aggregate per feature)."""
    return train_cells.groupBy(feature).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def scaler_apply(cells: DataFrame, fit: DataFrame, feature: str = FEAT, value: str = BETA,
                 name: str = "z") -> DataFrame:
    """z = (x - mean) / std, with std 0 -> 1.  ``fit`` has one row per feature,
    so AQE broadcasts it while the feature count is under the threshold."""
    std = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    return cells.join(fit, feature).withColumn(name, (F.col(value) - F.col("mean")) / std).drop("mean", "std")
