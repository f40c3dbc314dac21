"""Price-series operators on long ``(tk, dt, px)`` tables.

Layout rule: every window is ``partitionBy(ticker).orderBy(day number)`` with
``d = unix_date(dt)``; using one ordering column for row frames and calendar
range frames lets Spark evaluate all of them after a single shuffle and sort.
A series is one row per ticker and trading day, so a window partition is
bounded by the calendar, not by the data volume; raw rows are pre-aggregated
to that grain (with map-side partial aggregation) before they get here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import pct_change, pyround

TK, DT, PX = "tk", "dt", "px"


DAY = "_d"


def _with_day(df: DataFrame, dt: str) -> DataFrame:
    """Materialise the day number once: windows ordered by the same column
    share one sort (an inline ``unix_date`` gets a new alias per window and
    forces a re-sort for each)."""
    return df if DAY in df.columns else df.withColumn(DAY, F.unix_date(F.col(dt)))


def _win(tk: str, dt: str):
    return Window.partitionBy(tk).orderBy(DAY)


# ------------------------------------------------------------- sources S3/P8-P9/S10
def unpivot_prices(wide: DataFrame, date_col: str = DT, tickers: Sequence[str] | None = None,
                   tk: str = TK, px: str = PX) -> DataFrame:
    """Wide date x ticker matrix -> long series; missing prices are dropped."""
    cols = list(tickers) if tickers else [c for c in wide.columns if c != date_col]
    long = wide.unpivot([date_col], cols, tk, px)
    return long.filter(F.col(px).isNotNull())


def nonzero_series(df: DataFrame, px: str = PX) -> DataFrame:
    """Fill-missing-with-0 followed by dropping zero prices == keep real, non-zero prices."""
    v = F.col(px)
    return df.filter(v.isNotNull() & ~F.isnan(v) & (v != 0))


def min_history(df: DataFrame, end_date: str, min_rows: int = 3, tk: str = TK, dt: str = DT) -> DataFrame:
    """Rows before ``end_date`` of tickers that have at least ``min_rows`` of them."""
    before = df.filter(F.col(dt) < F.lit(end_date).cast("date"))
    n = F.count(F.lit(1)).over(Window.partitionBy(tk))
    return before.withColumn("_n", n).filter(F.col("_n") >= min_rows).drop("_n")


# ------------------------------------------------------------- W1/W2/W3
def _window_frame(series, size, stride, cap, tk, dt):
    series = _with_day(series, dt)
    w = _win(tk, dt)
    i = F.row_number().over(w) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(tk))
    return series.withColumn("_i", i).withColumn("_n", n)


def _label_row(size: int, stride: int, cap: int | None) -> Column:
    """Closed form of the sliding loop: the end row of window k is position size+stride*k."""
    i, n = F.col("_i"), F.col("_n")
    k = F.floor((i - F.lit(size)) / F.lit(stride))
    return ((i >= size) & ((i - size) % stride == 0) & (F.lit(True) if cap is None else k < cap)
            & F.when(k == 0, n > size).otherwise(n > F.lit(stride) * k - stride + 2 * size))


def _upto(n: Column, cap: int | None) -> Column:
    """All windows, unless the caller asks for at most ``cap`` a ticker."""
    return n if cap is None else F.least(F.lit(cap), n)


def count_windows(series: DataFrame, size: int = 275, stride: int = 75, cap: int | None = None,
                  tk: str = TK, dt: str = DT, px: str = PX) -> DataFrame:
    """One row per overlapping count window: its number, first day and label row."""
    f = _window_frame(series, size, stride, cap, tk, dt)
    f = f.withColumn("start_dt", F.lag(dt, size).over(_win(tk, dt)))
    return (f.filter(_label_row(size, stride, cap))
             .select(tk, ((F.col("_i") - size) / stride).cast("int").alias("window_no"),
                     "start_dt", F.col(dt).alias("end_dt"), px))


def window_points(series: DataFrame, size: int = 275, stride: int = 75, cap: int | None = None,
                  tk: str = TK, dt: str = DT, px: str = PX) -> DataFrame:
    """Window contents in long form (tk, window_no, pos, dt, px): what gets drawn.

    A row at position i belongs to windows k with 75k <= i < 75k+275 and k below
    the ticker's window count; the memberships are generated with ``sequence``
    (at most ceil(size/stride) per row), so no join and no pair enumeration.
    """
    f = _window_frame(series, size, stride, cap, tk, dt)
    n = F.col("_n")
    # number of windows of a series of length n (closed form of the loop)
    nwin = F.when(n <= size, F.lit(0)).otherwise(
        _upto(F.greatest(F.lit(1), F.floor((n - 2 * size + stride - 1) / F.lit(stride)) + 1), cap))
    i = F.col("_i")
    kmin = F.greatest(F.lit(0), F.floor((i - F.lit(size - 1) + F.lit(stride - 1)) / F.lit(stride)))
    kmax = F.least(F.floor(i / F.lit(stride)), nwin - 1)
    f = f.withColumn("_k", F.explode(F.when(kmin <= kmax, F.sequence(kmin.cast("int"), kmax.cast("int")))
                                      .otherwise(F.array().cast("array<int>"))))
    return f.select(tk, F.col("_k").alias("window_no"), (i - F.col("_k") * stride).cast("int").alias("pos"),
                    dt, px)


def window_arrays(series: DataFrame, size: int = 275, stride: int = 75, cap: int | None = None,
                  tk: str = TK, dt: str = DT, px: str = PX) -> DataFrame:
    """Window contents as ``ARRAY<DOUBLE>`` in date order, one row per window.

    Built from the window memberships and grouped by (ticker, window): the
    rows are already hash-partitioned by ticker, so the grouping adds no
    exchange, and only real windows build arrays (size is bounded by ``size``).
    """
    pts = window_points(series, size, stride, cap, tk, dt, px)
    agg = pts.groupBy(tk, "window_no").agg(F.array_sort(F.collect_list(F.struct("pos", px))).alias("_s"),
                                           F.max(dt).alias("last_dt"))
    return agg.select(tk, "window_no", "last_dt", F.transform("_s", lambda e: e[px]).alias("prices"))


HORIZONS = {"week": 8, "month": 31}


def forward_gain(series: DataFrame, horizons: Mapping[str, int] = HORIZONS,
                 tk: str = TK, dt: str = DT, px: str = PX) -> DataFrame:
    """Max price over the next h calendar days (both ends included) and the gain in %."""
    w = _win(tk, dt)
    out = _with_day(series, dt)
    for name, days in horizons.items():
        mx = F.max(px).over(w.rangeBetween(0, days))
        out = out.withColumn(f"{name}_max", mx).withColumn(f"{name}_gain", pct_change(px, f"{name}_max", None))
    return out if DAY in series.columns else out.drop(DAY)


def forward_labels(series: DataFrame, size: int = 275, stride: int = 75, cap: int | None = None,
                   horizons: Mapping[str, int] = HORIZONS, tk: str = TK, dt: str = DT, px: str = PX) -> DataFrame:
    """Count windows with their forward max and gain per horizon (one shuffle, one sort)."""
    f = _window_frame(series, size, stride, cap, tk, dt)
    f = f.withColumn("start_dt", F.lag(dt, size).over(_win(tk, dt)))
    f = forward_gain(f, horizons, tk, dt, px)
    cols = [tk, ((F.col("_i") - size) / stride).cast("int").alias("window_no"), "start_dt",
            F.col(dt).alias("end_dt"), px]
    for name in horizons:
        cols += [F.col(f"{name}_max"), F.col(f"{name}_gain")]
    return f.filter(_label_row(size, stride, cap)).select(*cols)


# ------------------------------------------------------------- P24/P25
# The reference's threshold ladders (percent gain).
MONTH_RUNGS = [50, 70, 90]
WEEK_RUNGS = [20, 30, 40, 50, 60]


def ladder_labels(gain, rungs: Sequence[float], prefix: str) -> Column:
    """Multi-label ladder: first rung passes on ``>=``, later rungs on ``>``.

    Below the first rung the row is ``<prefix>-Underperform``.  Rungs are
    ascending, so "all lower rungs passed" holds whenever a higher one passes.
    """
    g = gain if isinstance(gain, Column) else F.col(gain)
    parts = [F.when(g >= rungs[0] if j == 0 else g > r, F.lit(f"{prefix}{r}")) for j, r in enumerate(rungs)]
    passed = F.array_compact(F.array(*parts))
    return F.when(g < rungs[0], F.array(F.lit(f"{prefix}-Underperform"))).otherwise(passed)


def bucket_ladder(windows: DataFrame, month_gain: str = "month_gain", week_gain: str = "week_gain",
                  month_rungs=MONTH_RUNGS, week_rungs=WEEK_RUNGS) -> DataFrame:
    """One output row per (window, label directory) the window is written to."""
    labels = F.concat(ladder_labels(month_gain, month_rungs, "Month"), ladder_labels(week_gain, week_rungs, "Week"))
    return windows.withColumn("bucket", F.explode(labels))


def exclusive_bucket(gain, rungs: Sequence[float], prefix: str) -> Column:
    """Older single-label ladder: first ``gain < rung`` wins, else the top bucket."""
    g = gain if isinstance(gain, Column) else F.col(gain)
    expr = None
    for r in rungs:
        cond_val = F.lit(f"{prefix}<{r}")
        expr = F.when(g < r, cond_val) if expr is None else expr.when(g < r, cond_val)
    return expr.when(g.isNotNull(), F.lit(f"{prefix}>={rungs[-1]}"))


# ------------------------------------------------------------- W4-W9
def trailing_window(series: DataFrame, days: int = 1825, tk: str = TK, dt: str = DT, px: str = PX) -> DataFrame:
    """Per day, stats of the prices in the trailing ``days`` calendar days (inclusive).

    Every frame starts at the beginning of its partition, so Spark extends it row by
    row instead of aggregating the window anew: count and mean are differences of
    running sums; for the extremes days are cut into blocks as wide as the window, which
    then covers a block's beginning (running extremes) and at most the end of the block
    before (running extremes from the end, looked up at the window's first row).
    """
    width = days + 1
    s = _with_day(series, dt).select(tk, dt, px, DAY).withColumn("_b", F.floor(F.col(DAY) / width))
    start, win = Window.unboundedPreceding, _win(tk, dt)
    upto, gone = win.rangeBetween(start, 0), win.rangeBetween(start, -width)
    fore = Window.partitionBy(tk, "_b").orderBy(DAY).rangeBetween(start, 0)
    back = Window.partitionBy(tk, "_b").orderBy(F.desc(DAY)).rangeBetween(start, 0)
    over = lambda agg, c: agg(c).over(upto) - F.coalesce(agg(c).over(gone), F.lit(0))
    rows = s.select(tk, dt, px, "_b", F.count(F.lit(1)).over(gone).alias("_first"), over(F.count, px).alias("n_days"),
                    over(F.sum, px).alias("_sum"), F.min(px).over(fore).alias("_lo"), F.max(px).over(fore).alias("_hi"))
    ends = s.select(F.col(tk).alias("_tk"), F.col("_b").alias("_eb"), (F.row_number().over(win) - 1).alias("_i"),
                    F.min(px).over(back).alias("_elo"), F.max(px).over(back).alias("_ehi"))
    j = rows.join(ends, F.col(tk).eqNullSafe(F.col("_tk")) & (F.col("_first") == F.col("_i")), "left")
    before = F.col("_eb") < F.col("_b")
    return j.select(tk, dt, px, "n_days", F.least("_lo", F.when(before, F.col("_elo"))).alias("lo"),
                    F.greatest("_hi", F.when(before, F.col("_ehi"))).alias("hi"),
                    pyround(F.when(F.col("n_days") > 0, F.col("_sum") / F.col("n_days")), 4).alias("mean"))


def _frame(w: int, nominal: bool):
    return (-(w - 1), 0) if nominal else (-w, 0)


def sma(series: DataFrame, w=26, nominal: bool = False, tk: str = TK, dt: str = DT,
        px: str = PX, name: str | None = None) -> DataFrame:
    """Simple moving average(s) rounded to 2; NULL until the frame is full.

    The reference appends before averaging and pops after, so its frame holds
    w+1 prices and the first value is on row w+1; ``nominal=True`` uses w rows.
    ``w`` may be a list: all widths share one sort.
    """
    widths = [w] if isinstance(w, int) else list(w)
    win = _win(tk, dt)
    i = F.row_number().over(win) - 1
    out = _with_day(series, dt)
    for width in widths:
        lo, hi = _frame(width, nominal)
        v = F.when(i >= -lo, pyround(F.avg(px).over(win.rowsBetween(lo, hi)), 2))
        out = out.withColumn(name if (name and len(widths) == 1) else f"sma{width}", v)
    return out if DAY in series.columns else out.drop(DAY)


def bollinger(series: DataFrame, w: int = 26, k: float = 2.0, nominal: bool = False,
              tk: str = TK, dt: str = DT, px: str = PX) -> DataFrame:
    """SMA +/- k population standard deviations over the same frame."""
    lo, hi = _frame(w, nominal)
    win = _win(tk, dt)
    frame = win.rowsBetween(lo, hi)
    full = (F.row_number().over(win) - 1) >= -lo
    mean = pyround(F.avg(px).over(frame), 2)
    sd = F.stddev_pop(px).over(frame)
    return _with_day(series, dt).select(tk, dt, px, F.when(full, mean).alias("sma"),
                         F.when(full, pyround(mean + F.lit(k) * sd, 2)).alias("upper"),
                         F.when(full, pyround(mean - F.lit(k) * sd, 2)).alias("lower"))


def rsi(series: DataFrame, w: int = 12, tk: str = TK, dt: str = DT, px: str = PX) -> DataFrame:
    """Cutler RSI: simple averages of the last ``w`` up/down moves.

    No down move and some up move -> 100; neither -> NULL.
    """
    win = _win(tk, dt)
    chg = F.col(px) - F.lag(px).over(win)
    s = _with_day(series, dt).withColumn("_i", F.row_number().over(win) - 1) \
              .withColumn("_up", F.greatest(chg, F.lit(0.0))).withColumn("_dn", F.greatest(-chg, F.lit(0.0)))
    frame = win.rowsBetween(-(w - 1), 0)
    avg_u = F.sum("_up").over(frame) / F.lit(float(w))
    avg_d = F.sum("_dn").over(frame) / F.lit(float(w))
    value = (F.when(avg_d == 0, F.when(avg_u > 0, F.lit(100.0)))
              .otherwise(pyround(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + avg_u / avg_d), 2)))
    return s.select(tk, dt, px, F.when(F.col("_i") >= w, value).alias("rsi"))


def _round2(y: float) -> float:
    """numpy's 2-decimal rounding of a float64 scalar: scale, round half to even, unscale
    (the reference's prices are numpy scalars, so this is the rounding it applies)."""
    return round(y * 100.0) / 100.0


def _ema_batches(batches, windows: Sequence[int], tk: str, px: str):
    """Fold the EMA over rows sorted by (ticker, day), one Arrow batch at a time.

    The fold state (ticker, position, first prices for the seed, previous EMA)
    is carried across batch boundaries, so a series may span batches and the
    memory held is one batch, whatever the series length."""
    coef = {w: (2.0 / (w + 1), 1.0 - 2.0 / (w + 1)) for w in windows}
    need = max(windows) + 1
    cur, i, head, prev = None, 0, [], {}
    for pdf in batches:
        out = {w: [float("nan")] * len(pdf) for w in windows}
        for j, (t, p) in enumerate(zip(pdf[tk].tolist(), pdf[px].tolist())):
            if t != cur:
                cur, i, head, prev = t, 0, [], {w: None for w in windows}
            if len(head) < need:
                head.append(p)
            for w in windows:
                if i >= w:
                    a, b = coef[w]
                    if prev[w] is None:            # seed: same-row SMA over w+1 prices
                        prev[w] = _round2(sum(head[:w + 1]) / (w + 1))
                    prev[w] = _round2(p * a + prev[w] * b)
                    out[w][j] = prev[w]
            i += 1
        for w in windows:
            pdf[f"ema{w}"] = np.array(out[w], dtype=float)
        yield pdf


def ema(series: DataFrame, windows: Sequence[int] = (26, 12), tk: str = TK, dt: str = DT,
        px: str = PX) -> DataFrame:
    """EMA rounded to 2 decimals at every step (seed = same-row SMA).

    Per-step rounding makes the recurrence non-associative, so it cannot be a
    window sum.  Rows are hash-partitioned by ticker and sorted by (ticker, day)
    inside each partition; ``mapInPandas`` then folds the sorted Arrow batches
    in order, carrying the state across batch boundaries (no per-ticker frame is
    materialised).
    """
    from tessera.session import ship_package
    ship_package(series.sparkSession)             # workers import the fold by module reference
    fields = ", ".join(f"ema{w} double" for w in windows)
    schema = f"{series.schema.simpleString()[7:-1]}, {fields}"
    ordered = series.repartition(tk).sortWithinPartitions(tk, dt)
    return ordered.mapInPandas(lambda it: _ema_batches(it, tuple(windows), tk, px), schema)


def macd(series: DataFrame, long: int = 26, short: int = 12, sign: int = 1, tk: str = TK,
         dt: str = DT, px: str = PX) -> DataFrame:
    """``sign * (EMA_long - EMA_short)`` rounded to 2 (the reference's sign is +1)."""
    e = ema(series, (long, short), tk, dt, px)
    v = F.lit(float(sign)) * (F.col(f"ema{long}") - F.col(f"ema{short}"))
    return e.select(tk, dt, px, pyround(v, 2).alias("macd"))


# ------------------------------------------------------------- J7-J10, G16, G17
def asof(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str,
         direction: str = "backward", tolerance_days: int = 6,
         left_key: Sequence[str] | None = None) -> DataFrame:
    """As-of join on dates with a day tolerance.

    ``backward``: the latest right date in [t - tol, t]; ``forward``: the
    earliest in [t, t + tol].  Each left row is expanded to its tol+1 candidate
    days and equi-joined on (by, day), so the join never pairs all rows of a
    key (fan-out is the tolerance, a parameter); the best candidate per left
    row is kept with ``max_by``/``min_by``.  Unmatched left rows are kept with
    NULL right columns.  ``right`` must hold one row per (by, day).
    ``left_key`` names columns that identify a left row (deterministic under
    recomputation); without it a generated row id is used.
    """
    step = -1 if direction == "backward" else 1
    lid = F.struct(*left_key) if left_key else F.monotonically_increasing_id()
    expanded = (left.withColumn("_lid", lid)
                    .select("_lid", F.struct(*left.columns).alias("_l"), F.col(by).alias("_by"),
                            F.explode(F.sequence(F.lit(0), F.lit(tolerance_days))).alias("_o"),
                            F.col(left_on).alias("_t"))
                    .withColumn("_cd", F.date_add("_t", F.col("_o") * step)))
    r = right.withColumnRenamed(by, "_by").withColumnRenamed(right_on, "_cd")
    rcols = [c for c in r.columns if c not in ("_by", "_cd")]
    hits = expanded.join(r.withColumn("_hit", F.lit(True)), ["_by", "_cd"], "left")
    pick = F.max_by if direction == "backward" else F.min_by
    best = hits.groupBy("_lid").agg(
        F.first("_l").alias("_l"),
        pick(F.struct(F.col("_cd").alias(right_on), *rcols), F.when(F.col("_hit"), F.col("_cd"))).alias("_m"))
    return best.select("_l.*", F.col(f"_m.{right_on}").alias(f"match_{right_on}"),
                       *[F.col(f"_m.{c}").alias(c) for c in rcols])


def labelled_windows(series: DataFrame, size: int = 275, stride: int = 75, cap: int | None = None,
                     tk: str = TK, dt: str = DT, px: str = PX) -> DataFrame:
    """Window price arrays with every label directory they belong to (what the
    reference writes as one image per label); write with
    ``sources.write_table(df, path, partition_by=["bucket"])``."""
    labels = bucket_ladder(forward_labels(series, size, stride, cap, HORIZONS, tk, dt, px)) \
        .select(tk, "window_no", "end_dt", "bucket")
    arrays = window_arrays(series, size, stride, cap, tk, dt, px)
    return labels.join(arrays, [tk, "window_no"])
