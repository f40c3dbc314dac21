"""Hyper-parameter trials.

Trials are plain rows.  Grids are Cartesian products of parameter lists;
random search draws from a space with the same md5 uniform the rest of the
library uses, so the draws are reproducible in SQL.  Evaluating a set of
trials over data counts rows by the interval of the sorted thresholds they fall
in (one scan, one partial aggregate); trials are then sums over those intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def py_uniform(seed, *keys) -> float:
    """Python twin of ``functions.random.uniform``."""
    s = "|".join([str(seed)] + [str(k) for k in keys])
    return int(hashlib.md5(s.encode()).hexdigest()[:8], 16) / 4294967296.0


def param_grid(**lists: Sequence) -> list[dict]:
    """Cartesian product in the order given, numbered from 1 (``trial``)."""
    out = [{}]
    for name, values in lists.items():
        out = [dict(t, **{name: v}) for t in out for v in values]
    return [dict(trial=i + 1, **t) for i, t in enumerate(out)]


def param_random(space: Mapping[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """``n`` draws; space entries are ('uniform', lo, hi) or ('quniform', lo, hi, q).

    quniform rounds half-to-even to the step: round(v / q) * q.
    """
    rows = []
    for i in range(1, n + 1):
        row = {"trial": i}
        for name, spec in space.items():
            u = py_uniform(seed, name, i)
            v = spec[1] + (spec[2] - spec[1]) * u
            if spec[0] == "quniform":
                v = round(v / spec[3]) * spec[3]
            row[name] = v
        rows.append(row)
    return rows


def _intervals(df: DataFrame, p: str, edges: Sequence[float], name: str) -> DataFrame:
    """``name``: how many of the sorted ``edges`` lie strictly below ``p`` (not null).

    The bucketizer searches by bisection; its buckets are closed below, so both sides are negated."""
    from pyspark.ml.feature import Bucketizer
    splits = [float("-inf"), *sorted(-e for e in edges), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_minus", outputCol="_from_top", handleInvalid="keep")
    above = F.when(F.isnan("_minus"), F.lit(0)).otherwise(F.col("_from_top")).cast("int")     # NaN exceeds every edge
    return cut.transform(df.withColumn("_minus", -F.col(p).cast("double"))).withColumn(name, F.lit(len(edges)) - above)


def _trials_col(trials: Sequence[Mapping]) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in t.items()]) for t in trials]))


def evaluate_thresholds(df: DataFrame, trials: Sequence[Mapping], y: str = "y", p: str = "p") -> DataFrame:
    """Confusion counts of every trial's ``threshold`` and the trial objective
    ``weight * recall + (1 - weight) * precision``.  Rows without a score or a label count nowhere."""
    edges = sorted({float(t["threshold"]) for t in trials})
    known = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    counts = _intervals(known, p, edges, "_at").groupBy("_at") \
        .agg(F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) != 1).alias("_neg"))
    # at most (thresholds + 1) x trials rows, whatever the data
    ex = counts.select("*", _trials_col([dict(t, _edge=edges.index(float(t["threshold"]))) for t in trials]).alias("_t")) \
        .select("_at", "_pos", "_neg", "_t.*")
    keys = list(trials[0].keys())
    pred = F.col("_at") > F.col("_edge")
    total = lambda c, n: F.sum(F.when(c, F.col(n)).otherwise(F.lit(0))).alias
    agg = ex.groupBy(*keys).agg(total(pred, "_pos")("tp"), total(pred, "_neg")("fp"),
                                total(~pred, "_neg")("tn"), total(~pred, "_pos")("fn"))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    return agg.withColumn("recall", rec).withColumn("precision", prec) \
              .withColumn("objective", F.col("weight") * rec + (F.lit(1.0) - F.col("weight")) * prec)


def best_trial(trials: DataFrame, metric: str = "objective", mode: str = "max", key: str = "trial") -> DataFrame:
    """The best trial (ties: lowest trial number) in one ``max_by`` aggregate
    ordered by (metric, -trial)."""
    m = F.col(metric) if mode == "max" else -F.col(metric)
    best = trials.agg(F.max_by(F.struct(*trials.columns), F.struct(m, -F.col(key))).alias("_b"))
    return best.select("_b.*")


def run_name(prefix: str, *params) -> Column:
    """``prefix-p1-p2-...`` from parameter columns (their string form)."""
    return F.concat_ws("-", F.lit(prefix), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                             for c in params])


# Fixed values: (timeframe, threshold) -> (layer size, epochs) of the dense price model.
LAYER_TABLE = [
    ("Week", 22, 400, 10),
    ("Week", 30, 250, 10),
    ("Week", 40, 200, 10),
    ("Week", 50, 150, 5),
    ("Week", 60, 125, 5),
    ("Month", 50, 600, 10),
    ("Month", 70, 450, 10),
    ("Month", 90, 375, 10),
    ("Month", 120, 300, 10),
]


def param_lookup(df: DataFrame, timeframe: str, threshold: str) -> DataFrame:
    """Attach layer size and epochs by (timeframe, threshold); unknown pairs get NULL.

    The parameter table is a fixed 9-row literal: a proven broadcast bound."""
    spark = df.sparkSession
    table = spark.createDataFrame(LAYER_TABLE, "timeframe string, threshold int, layer_size int, epochs int")
    return df.join(F.broadcast(table.withColumnRenamed("timeframe", timeframe).withColumnRenamed("threshold", threshold)),
                   [timeframe, threshold], "left")
