"""Exact global positions without a single-partition window.

``row_number() over (order by k)`` with no ``partition by`` moves every row to
one task.  ``global_rank`` gets the same numbers with a distributed sort:

1. ``orderBy`` range-partitions the rows (sampled bounds, balanced tasks) and
   sorts inside each partition;
2. ``monotonically_increasing_id`` right after the sort encodes
   (partition index, offset inside the partition);
3. the tagged rows are written once with a reliable ``checkpoint()``: the
   range bounds come from a sample whose result depends on the order rows
   arrive in after a shuffle, so the counts and the rows must be read from
   one materialisation (this also makes the positions survive executor loss);
4. a per-partition row count (one row per partition, so its size is bounded by
   the partition count, not by the data) gives each partition's start offset.

The order must be total (add a unique key as the last sort column), otherwise
positions of tied rows are arbitrary exactly as with ``row_number``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

_LOW_BITS = (1 << 33) - 1


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "pos",
                base: int = 1, partition_by: Sequence[str] = ()) -> DataFrame:
    """Add ``name`` = position of each row under ``order`` (``base``-based).

    With ``partition_by`` the position restarts in every group, like
    ``row_number() over (partition by g order by ...)``, but a hot group is
    spread over many sorted range partitions instead of one task.
    """
    pb = list(partition_by)
    cols = [F.col(c) for c in pb] + [c if isinstance(c, Column) else F.col(c) for c in order]
    tagged = cut_lineage(df.orderBy(*cols)
                         .withColumn("__gr_part", F.spark_partition_id())
                         .withColumn("__gr_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))))
    if not pb:
        per_part = tagged.groupBy("__gr_part").agg(F.count(F.lit(1)).alias("__gr_n"))
        offsets = per_part.select(
            "__gr_part",
            F.coalesce(F.sum("__gr_n").over(Window.orderBy("__gr_part").rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0)).alias("__gr_off"))
        # one row per shuffle partition: a proven size bound for the broadcast
        return (tagged.join(F.broadcast(offsets), "__gr_part")
                      .withColumn(name, (F.col("__gr_off") + F.col("__gr_row") + F.lit(base)).cast("bigint"))
                      .drop("__gr_part", "__gr_row", "__gr_off"))
    # rows of a group are contiguous inside a sorted partition: start = min(_row)
    per = tagged.groupBy("__gr_part", *pb).agg(F.count(F.lit(1)).alias("__gr_n"), F.min("__gr_row").alias("__gr_start"))
    before = Window.partitionBy(*pb).orderBy("__gr_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__gr_part", *pb, "__gr_start", F.coalesce(F.sum("__gr_n").over(before), F.lit(0)).alias("__gr_off"))
    # at most (partitions + groups) rows; AQE broadcasts it when it is small
    return (tagged.join(per, ["__gr_part", *pb])
                  .withColumn(name, (F.col("__gr_off") + F.col("__gr_row") - F.col("__gr_start") + F.lit(base)).cast("bigint"))
                  .drop("__gr_part", "__gr_row", "__gr_off", "__gr_start"))


def row_count(df: DataFrame) -> int:
    """One number to the driver.  Use on small or materialised frames (e.g. the
    checkpointed output of ``global_rank``): a scalar subquery referenced
    several times in a plan is planned and executed once per reference."""
    return int(df.select(F.count(F.lit(1))).first()[0])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], group_by: Sequence[str] = (),
                    prefix: str = "q") -> DataFrame:
    """Linear-interpolation quantiles (numpy's default) per group, exactly.

    Instead of ``percentile`` (which holds a whole group in one buffer) the
    different values are counted and put in order (``value_positions``); a value
    answers the positions it covers, so a value that fills most of a group is one row.
    """
    gb = list(group_by)
    vals = df.filter(F.col(value).isNotNull()).select(*gb, value)
    at = value_positions(vals, value, gb)
    if gb:
        at = at.join(at.groupBy(*gb).agg(F.sum("n_rows").alias("_n")), gb)
    else:
        at = at.withColumn("_n", F.lit(at.agg(F.sum("n_rows")).first()[0]).cast("bigint"))   # one number
    last = F.col("_n") - 1
    need = F.array(*[F.struct(F.lit(float(p)).alias("_p"), (last * F.lit(float(p))).alias("_h"), k(last * F.lit(float(p))).alias("_k"))
                     for p in probs for k in (F.floor, F.ceil)])
    mine = F.filter(need, lambda x: (x["_k"] >= F.col("before")) & (x["_k"] < F.col("before") + F.col("n_rows")))
    j = at.select(*gb, F.col(value).alias("_v"), F.explode(mine).alias("_x")).select(*gb, "_v", "_x.*")
    per = j.groupBy(*gb, "_p").agg(F.first("_h").alias("_h"), F.min("_v").alias("_vlo"), F.max("_v").alias("_vhi"))
    j = per.withColumn("_q", F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_h") - F.floor("_h")))
    return j.groupBy(*gb).agg(*[F.max(F.when(F.col("_p") == float(p), F.col("_q"))).alias(f"{prefix}{int(round(p * 100))}")
                                for p in probs])


def value_positions(df: DataFrame, value: str, group_by: Sequence[str] = ()) -> DataFrame:
    """(group, value, n_rows, before): how many rows hold each different value and how many hold smaller ones.

    Rows are counted per value before anything is sorted, so ties, however many, are one
    row; a hot group is spread over sorted range partitions as in ``global_rank``."""
    gb = list(group_by)
    counts = df.groupBy(*gb, value).agg(F.count(F.lit(1)).alias("n_rows"))
    tagged = cut_lineage(counts.orderBy(*gb, value).withColumn("__gr_part", F.spark_partition_id())
                         .withColumn("__gr_row", F.monotonically_increasing_id()))
    per = tagged.groupBy("__gr_part", *gb).agg(F.sum("n_rows").alias("__gr_n"))
    # one row per partition and group in it
    before = (Window.partitionBy(*gb) if gb else Window.partitionBy(F.lit(0))).orderBy("__gr_part") \
        .rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__gr_part", *gb, F.coalesce(F.sum("__gr_n").over(before), F.lit(0)).alias("__gr_off"))
    inside = Window.partitionBy("__gr_part", *gb).orderBy("__gr_row").rowsBetween(Window.unboundedPreceding, -1)
    return (tagged.withColumn("__gr_in", F.coalesce(F.sum("n_rows").over(inside), F.lit(0)))
                  .join(per, ["__gr_part", *gb])
                  .select(*gb, value, "n_rows", (F.col("__gr_off") + F.col("__gr_in")).cast("bigint").alias("before")))
