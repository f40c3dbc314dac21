"""Year-prior return versus an index, from as-of samples (J7-J10, G16, G17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import pyround
from tessera.operators.timeseries import DT, PX, TK, asof

# Epoch second 953337600 = 2000-03-18: forward samples must fall after it.
FORWARD_FLOOR = "2000-03-18"


def _offsets(offsets: Sequence[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.lit(d).alias("days")) for z, d in offsets]))


def last_points(series: DataFrame, tk: str = TK, dt: str = DT, px: str = PX) -> DataFrame:
    """First and latest trading day and latest price per ticker (one partial aggregate)."""
    return series.groupBy(tk).agg(F.min(dt).alias("first_dt"), F.max(dt).alias("last_dt"), F.max_by(px, dt).alias("current"))


def backward_samples(series: DataFrame, index: DataFrame, offsets: Sequence[tuple[int, int]],
                     tolerance_days: int = 6, tk: str = TK, dt: str = DT, px: str = PX,
                     sp: str = "sp") -> DataFrame:
    """Samples around the date one year before each ticker's last day.

    Target z lies ``days_z`` after (even z) or before (odd z) the prior-year
    date; the sample is the latest day within ``tolerance_days`` before the
    target on which both the ticker and the index have a value.  Sampling stops at
    the first target (in offset order) whose search runs past the ticker's first
    day: that offset and all later ones give no row.
    """
    both = series.join(index, dt)           # index: one row per day, so no fan-out
    anchor = last_points(series, tk, dt, px).select(tk, "first_dt", F.add_months("last_dt", -12).alias("prior_dt"))
    targets = anchor.select(tk, "first_dt", "prior_dt", _offsets(offsets).alias("_o")).select(
        tk, "first_dt", F.col("_o.z").alias("z"),
        F.when(F.col("_o.z") % 2 == 0, F.date_add("prior_dt", F.col("_o.days")))
         .otherwise(F.date_sub("prior_dt", F.col("_o.days"))).alias("target"))
    found = asof(targets, both.select(tk, dt, px, sp), tk, "target", dt, "backward", tolerance_days, [tk, "z"])
    past = F.col(f"match_{dt}").isNull() & (F.date_sub("target", tolerance_days) < F.col("first_dt"))
    stop = F.min(F.when(past, F.col("z"))).over(Window.partitionBy(tk))     # one row per offset and ticker
    return found.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("z") < F.col("_stop"))).drop("_stop", "first_dt")


def _forward_targets(offsets: Sequence[tuple[int, int]], floor: str) -> Column:
    """Array of (b, target) after ``floor``, up to the first target before the ticker's first day."""
    every = F.array(*[F.struct(F.lit(z).alias("b"), F.date_sub("last_dt", d).alias("target")) for z, d in offsets])
    asked = F.filter(every, lambda o: o["target"] > F.lit(floor).cast("date"))
    stop = F.array_min(F.transform(F.filter(asked, lambda o: o["target"] < F.col("first_dt")), lambda o: o["b"]))
    return F.filter(asked, lambda o: stop.isNull() | (o["b"] < stop))


def forward_samples(series: DataFrame, offsets: Sequence[tuple[int, int]], tolerance_days: int = 9,
                    floor: str = FORWARD_FLOOR, tk: str = TK, dt: str = DT, px: str = PX) -> DataFrame:
    """Samples ``days_b`` before each ticker's last day: earliest price within the tolerance after it.

    Sampling stops at the first target before the ticker's first day (that offset and
    later ones give no row)."""
    last = last_points(series, tk, dt, px)
    targets = last.select(tk, F.explode(_forward_targets(offsets, floor)).alias("_o")).select(tk, "_o.b", "_o.target")
    return asof(targets, series.select(tk, dt, px), tk, "target", dt, "forward", tolerance_days, [tk, "b"])


def prior_averages(series: DataFrame, index: DataFrame, back_offsets, far_offsets, recent_offsets,
                   tk: str = TK, dt: str = DT, px: str = PX) -> DataFrame:
    """Per ticker: prior (year-ago) mean price and index, far and recent averages.

    Far and recent samples share one tagged as-of pass (one expansion, one join,
    one grouping); the per-ticker last-point table doubles as the ticker list.
    """
    last = last_points(series, tk, dt, px)
    back = (backward_samples(series, index, back_offsets, tk=tk, dt=dt, px=px).groupBy(tk)
            .agg(F.avg("px").alias("prior"), F.avg("sp").alias("sp_prior")))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), _forward_targets(o, FORWARD_FLOOR).alias("at"))
                      for k, o in (("far", far_offsets), ("recent", recent_offsets))])
    targets = last.select(tk, F.inline(kinds)).select(tk, "kind", F.inline("at"))
    fwd = asof(targets, series.select(tk, dt, px), tk, "target", dt, "forward", 9, [tk, "kind", "b"])
    avgs = fwd.groupBy(tk).agg(
        pyround(F.avg(F.when(F.col("kind") == "far", F.col(px))), 2).alias("far_avg"),
        pyround(F.avg(F.when(F.col("kind") == "recent", F.col(px))), 2).alias("recent_avg"))
    return last.select(tk).join(back, tk, "left").join(avgs, tk, "left")


def year_prior_return(series: DataFrame, index: DataFrame, back_offsets, tk: str = TK, dt: str = DT,
                      sp: str = "sp") -> DataFrame:
    """Return since a year ago, the index's return, and the outperformance (their difference)."""
    last = last_points(series, tk, dt)
    cur = last.join(index.withColumnRenamed(dt, "last_dt").withColumnRenamed(sp, "sp_current"), "last_dt", "left")
    back = (backward_samples(series, index, back_offsets).groupBy(tk)
            .agg(F.avg("px").alias("prior"), F.avg("sp").alias("sp_prior")))
    j = cur.join(back, tk, "left")
    diff = pyround(F.try_divide(F.col("current") - F.col("prior"), F.col("prior")) * 100.0, 2)
    idx = pyround(F.try_divide(F.col("sp_current") - F.col("sp_prior"), F.col("sp_prior")) * 100.0, 2)
    return j.select(tk, "last_dt", "current", "sp_current", diff.alias("year_prior_diff"),
                    idx.alias("sp_year_prior"), (diff - idx).alias("outperformance"))
