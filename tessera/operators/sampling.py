"""Seeded sampling, shuffling and splitting.

Randomness is ``functions.random.uniform(seed, key)``: a pure function of the
row, so results repeat across runs, partitionings and recomputed tasks.
Positions come from ``ranking.global_rank`` (a distributed sort), never from
a window without ``partition by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.random import uniform
import math

from tessera.operators.ranking import global_rank, row_count


#: Parts into which a class is cut before the per-class sample.
SALTS = 64


def shuffle(df: DataFrame, key: str, seed: int = 42, name: str = "pos") -> DataFrame:
    """Shuffle = order by a keyed hash; ``name`` is the 1-based shuffled position."""
    return global_rank(df.withColumn("_u", uniform(seed, key)), ["_u", key], name).drop("_u")


def sample_per_class(df: DataFrame, cls: str, key: str, k: int = 500, seed: int = 42) -> DataFrame:
    """At most ``k`` rows per class, uniformly without replacement.

    Two stages: the first ``k`` of each of ``SALTS`` parts of a class, then the first
    ``k`` of those, so a hot class is never one task and the last stage sees at most
    ``SALTS * k`` rows of it.
    """
    order = [uniform(seed, key), F.col(key)]
    salted = Window.partitionBy(cls, F.pmod(F.xxhash64(key), F.lit(SALTS))).orderBy(*order)
    first = df.withColumn("_r", F.row_number().over(salted)).filter(F.col("_r") <= k)
    w = Window.partitionBy(cls).orderBy(*order)
    return first.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def two_class_set(items: DataFrame, cls: str, key: str, positive: str, negative: str, k: int = 500,
                  train: float = 0.8, seed: int = 42) -> DataFrame:
    """Two labelled classes in one set: at most ``k`` items each, ``label`` 1 / 0, a shuffled
    ``split`` (train / eval) and the ``share`` of the row's class."""
    both = items.filter(F.col(cls).isin(positive, negative)).withColumn("label", (F.col(cls) == positive).cast("int"))
    out = shuffle(sample_per_class(both, cls, key, k, seed), key, seed + 1, "_pos")
    n = row_count(out)                               # at most 2k rows from here on
    share = F.count(F.lit(1)).over(Window.partitionBy("label")) / F.lit(max(n, 1))
    return out.withColumn("share", share).withColumn(
        "split", F.when(F.col("_pos") <= math.floor(n * train), F.lit("train")).otherwise(F.lit("eval"))).drop("_pos")


def sample_half(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The first floor(n/2) rows of a seeded shuffle."""
    ranked = shuffle(df, key, seed, "_pos")          # checkpointed positions
    n = row_count(ranked)
    return ranked.filter(F.col("_pos") <= n // 2).drop("_pos")


def split3(df: DataFrame, key: str, test: float, val: float | None = None, seed: int = 42,
           name: str = "split") -> DataFrame:
    """Exact-size two-stage split of the entities ``key`` (scikit-learn sizes): test =
    ceil(n*test), val = ceil((n - n_test) * val) of the remainder, the rest train.

    Only the ids are ranked; every row of ``df`` then takes its entity's split."""
    ranked = shuffle(df.select(key).distinct(), key, seed, "_pos")          # checkpointed positions of ids
    n = row_count(ranked)
    n_test = math.ceil(n * test)
    pos = F.col("_pos")
    label = F.when(pos <= n_test, F.lit("test"))
    if val:
        n_val = math.ceil((n - n_test) * val)
        label = label.when(pos <= n_test + n_val, F.lit("val"))
    return _by_id(df, ranked.select(key, label.otherwise(F.lit("train")).alias(name)), [key])


def _by_id(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the further columns of ``ids``, one row per (possibly null) key."""
    other = ids.withColumnsRenamed({k: f"_id_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(other[f"_id_{k}"])
    return df.join(other, same).drop(*[f"_id_{k}" for k in keys])


def split_prefix(df: DataFrame, order: Sequence[str], frac: float = 0.8, name: str = "split") -> DataFrame:
    """Positional split: the first floor(frac*n) rows in ``order`` train, the rest eval."""
    ranked = global_rank(df, list(order), "_pos")
    n = row_count(ranked)
    return ranked.withColumn(name, F.when(F.col("_pos") <= math.floor(n * frac), F.lit("train"))
                             .otherwise(F.lit("eval"))).drop("_pos")


def fold_of(pos0: Column, n: int, k: int) -> Column:
    """Contiguous k-fold id of a 0-based position; the first n mod k folds are one larger."""
    base, extra = divmod(n, k)
    bound = extra * (base + 1)
    return F.when(pos0 < bound, F.floor(pos0 / (base + 1))).otherwise(
        F.lit(extra) + F.floor((pos0 - bound) / max(base, 1))).cast("int")


def kfold_ids(df: DataFrame, order: Sequence[str], k: int = 4, name: str = "fold") -> DataFrame:
    """Unshuffled contiguous k-fold assignment (scikit-learn ``KFold``) of the entities ``order``
    names; only those columns are ranked."""
    ranked = global_rank(df.select(*order).distinct(), list(order), "_pos", base=0)
    n = row_count(ranked)
    return _by_id(df, ranked.select(*order, fold_of(F.col("_pos"), n, k).alias(name)), list(order))
