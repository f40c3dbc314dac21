"""Aggregates and statistics.  Every statistic is one or two
``groupBy`` aggregates with map-side partial aggregation; nothing collects a
group's values into one buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import exact_quantiles, value_positions


def class_distribution(df: DataFrame, label: str = "label", ddof: int = 0) -> DataFrame:
    """Rows per class, fraction and percent of all rows; ``ddof=1`` divides by n-1.

    ``log_inv`` is the log-odds style initial bias ``log(1/p)`` of the class.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # one row per class: a window over this table is bounded by the class count
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    frac = F.col("n") / (total - F.lit(ddof))
    return counts.select(label, "n", frac.alias("frac"), (frac * 100.0).alias("pct"),
                         F.log(F.lit(1.0) / frac).alias("log_inv"))


def histogram(df: DataFrame, value: str, bins: int = 10, group_by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram over [min, max]; the last bin is closed (numpy rule).

    Per-group ranges are a small aggregate joined on the group key; without
    groups the range is a pair of scalar subqueries (no join at all)."""
    gb = list(group_by)
    v = df.filter(F.col(value).isNotNull())
    if gb:
        rng = df.groupBy(*gb).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        j = v.join(rng, gb)
        lo, hi = F.col("_lo"), F.col("_hi")
    else:
        j = v
        r = df.agg(F.min(value), F.max(value)).first()      # two numbers, read once
        lo, hi = F.lit(r[0]), F.lit(r[1])
    width = hi - lo
    b = F.when(width == 0, F.lit(bins // 2 + 1)).otherwise(
        F.least(F.floor((F.col(value) - lo) / width * bins) + 1, F.lit(bins)))
    out = j.groupBy(*gb, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    if gb:
        out = out.join(rng, gb)
    edge = lambda k: lo + (hi - lo) * k / F.lit(float(bins))
    return out.select(*gb, "bin", edge(F.col("bin") - 1).alias("lo"), edge(F.col("bin")).alias("hi"), "n")


def box_stats(df: DataFrame, value: str, group_by: Sequence[str] = (), whisker: float = 1.5) -> DataFrame:
    """Quartiles (linear interpolation), whiskers at the extreme data inside
    ``whisker * IQR`` of the box, and the number of points outside."""
    gb = list(group_by)
    v = F.col(value)
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], gb)
    if gb:
        j = df.filter(v.isNotNull()).join(q, gb)          # one row per group
        q25, q50, q75 = F.col("q25"), F.col("q50"), F.col("q75")
    else:
        j = df.filter(v.isNotNull())
        r = q.first()                                         # three numbers, read once
        q25, q50, q75 = F.lit(r["q25"]), F.lit(r["q50"]), F.lit(r["q75"])
    iqr = q75 - q25
    inside = (v >= q25 - F.lit(whisker) * iqr) & (v <= q75 + F.lit(whisker) * iqr)
    agg = j.groupBy(*gb).agg(
        F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"), F.count(F.lit(1)).alias("n"))
    if gb:
        agg = agg.join(q, gb)
    return agg.select(*gb, q25.alias("q25"), q50.alias("q50"), q75.alias("q75"), iqr.alias("iqr"),
                      "whisker_lo", "whisker_hi", "n_outliers", "n")


def confusion(df: DataFrame, y: str = "y", p: str = "p", threshold=0.5,
              group_by: Sequence[str] = ()) -> DataFrame:
    """Binary confusion counts, precision, recall, accuracy (0 on an empty denominator).

    ``threshold`` may be a column (e.g. one row per candidate threshold)."""
    pred = F.col(p) > (threshold if isinstance(threshold, Column) else F.lit(threshold))
    truth = F.col(y) == 1
    agg = df.groupBy(*group_by).agg(
        F.count_if(pred & truth).alias("tp"), F.count_if(pred & ~truth).alias("fp"),
        F.count_if(~pred & ~truth).alias("tn"), F.count_if(~pred & truth).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return agg.select(*group_by, "tp", "fp", "tn", "fn",
                      safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"),
                      safe(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", group_by: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE, R^2 = 1 - SSres/SStot (not squared correlation), mean net error (predicted minus actual).

    SStot uses the shifted form sum(y^2) - n*mean^2 so one pass suffices.
    """
    e = F.col(y) - F.col(yhat)
    agg = df.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.sum(e * e).alias("_ssres"), F.var_pop(y).alias("_vy"), F.avg(-e).alias("mean_error"))
    r2 = F.lit(1.0) - F.try_divide(F.col("_ssres"), F.col("_vy") * F.col("n"))
    return agg.select(*group_by, "n", "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"), "mean_error")


def fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line y = slope * x + intercept."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("pearson"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks (ties share their mean rank).

    Rows are counted per (x, y) first and ranks come from counts of values, so a value
    that most rows share is neither sorted nor joined more than once per pair."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = both.groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_w"))
    rank = lambda c, v, r: value_positions(both.select(F.col(c).alias(v)), v).select(
        v, (F.col("before") + (F.col("n_rows") + 1) / 2.0).alias(r))
    ranked = pairs.join(rank(x, "_x", "_rx"), "_x").join(rank(y, "_y", "_ry"), "_y")
    # ranks have the mean (n + 1) / 2; halves are exact in floating point
    mid = (F.lit(both.count()) + 1) / 2.0
    dx, dy, w = F.col("_rx") - mid, F.col("_ry") - mid, F.col("_w")
    s = ranked.agg(F.sum(w * dx * dy).alias("xy"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy"))
    return s.select(F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("spearman"))


def average_rank(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Average rank (1-based; ties share the mean of their positions): rows before the
    value plus half of those that hold it."""
    at = value_positions(df.filter(F.col(value).isNotNull()).select(value), value)
    return df.join(at.select(value, (F.col("before") + (F.col("n_rows") + 1) / 2.0).alias(name)), value)


def mutual_info_binned(cells: DataFrame, labels: DataFrame, key: str, feature: str, value: str,
                       y: str, bins: int = 10, y_bins: int | None = None) -> DataFrame:
    """Plug-in mutual information between an equal-width-binned feature and a class.

    ``y_bins`` bins a continuous target the same way (G7).  Three aggregates:
    range per feature, counts per (feature, bin, class), then the MI sum; all
    partial-aggregated, nothing holds a feature's values in memory.
    """
    j = cells.filter(F.col(value).isNotNull()).join(labels.filter(F.col(y).isNotNull()), key)
    rng = j.groupBy(feature).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    j = j.join(rng, feature)
    width = F.col("_hi") - F.col("_lo")
    xb = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("_lo")) / width * bins), F.lit(bins - 1)))
    if y_bins:
        r = labels.agg(F.min(y), F.max(y)).first()        # target range: two numbers, read once
        ylo, yhi = F.lit(r[0]), F.lit(r[1])
        yw = yhi - ylo
        yb = F.when(yw == 0, F.lit(0)).otherwise(
            F.least(F.floor((F.col(y) - ylo) / yw * y_bins), F.lit(y_bins - 1)))
    else:
        yb = F.col(y)
    cnt = j.groupBy(feature, xb.cast("int").alias("_xb"), yb.cast("string").alias("_yb")).agg(
        F.count(F.lit(1)).alias("_nxy"))
    wf = Window.partitionBy(feature)
    cnt = (cnt.withColumn("_n", F.sum("_nxy").over(wf))
              .withColumn("_nx", F.sum("_nxy").over(Window.partitionBy(feature, "_xb")))
              .withColumn("_ny", F.sum("_nxy").over(Window.partitionBy(feature, "_yb"))))
    term = F.col("_nxy") / F.col("_n") * F.log(F.col("_nxy") * F.col("_n") / (F.col("_nx") * F.col("_ny")))
    return cnt.groupBy(feature).agg(F.sum(term).alias("mi"))


def select_features(mi: DataFrame, c: float | Sequence[float] = 2.0, feature: str = "feature", score: str = "mi") -> DataFrame:
    """Keep features whose score is strictly above ``c`` times the mean score; several ``c``
    give one selection each, told apart by ``factor``."""
    mean = F.avg(score).over(Window.partitionBy(F.lit(0)))       # one row per feature
    out = mi.withColumn("_mean", mean)
    if isinstance(c, (int, float)):
        return out.filter(F.col(score) > F.lit(float(c)) * F.col("_mean")).drop("_mean")
    out = out.withColumn("factor", F.explode(F.array(*[F.lit(float(x)) for x in c])))
    return out.filter(F.col(score) > F.col("factor") * F.col("_mean")).drop("_mean")


_EULER = 0.5772156649015329
# psi(n) = H(n-1) - Euler-Mascheroni for small integers (exact harmonic numbers)
_PSI_SMALL = {n: sum(1.0 / j for j in range(1, n)) - _EULER for n in range(1, 11)}


def digamma_int(n) -> Column:
    """Digamma of a positive integer column: exact for n <= 10, asymptotic series
    beyond (truncation error below 1e-14)."""
    c = n if isinstance(n, Column) else F.col(n)
    x = c.cast("double")
    asym = (F.log(x) - F.lit(0.5) / x - F.lit(1.0 / 12) / (x * x) + F.lit(1.0 / 120) / F.pow(x, 4)
            - F.lit(1.0 / 252) / F.pow(x, 6) + F.lit(1.0 / 240) / F.pow(x, 8))
    expr = None
    for k, v in _PSI_SMALL.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr.otherwise(asym)


def mutual_info_knn(cells: DataFrame, labels: DataFrame, key: str, feature: str, value: str, y: str,
                    k: int = 3) -> DataFrame:
    """k-nearest-neighbour mutual information between a continuous feature and a class, see ``class_neighbours``."""
    from tessera.operators.class_neighbours import mutual_info_knn as by_blocks
    return by_blocks(cells, labels, key, feature, value, y, k)
