"""Query keys for price-series labelling and indicators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.numeric import pct_change, pyround
from tessera.operators import returns as R
from tessera.operators import timeseries as T
from tessera.operators.sampling import shuffle
from tessera.plans.fixture_sql import sql_uniform
from tessera.session import checkpoint_dir
from tessera.sources.files import write_table
from tessera.plans import fixtures as X
from tessera.plans.registry import register

D = "datediff('day', DATE '1970-01-01', dt)"
W = "PARTITION BY tk ORDER BY " + D

# Fixed parameters of the sampling (offset number, days).
BACK_OFFSETS = [(z, 7 * z) for z in range(1, 9)]
FAR_OFFSETS = [(b, 90 * b) for b in range(1, 8)]
RECENT_OFFSETS = [(b, 7 * b) for b in range(1, 5)]


def _sql_offsets(offs):
    return "(VALUES " + ", ".join(f"({z}, {d})" for z, d in offs) + ") o(z, days)"


@register("unpivot_prices", f"""
SELECT dt, tk, px FROM (UNPIVOT prices_wide ON {", ".join(f"n{n:02d}" for n in range(25))} INTO NAME tk VALUE px)
WHERE px IS NOT NULL""")
def q_unpivot_prices(spark, sf):
    return T.unpivot_prices(X.prices_wide(spark, sf))


@register("nonzero_series", """
SELECT tk, dt, px FROM series WHERE px IS NOT NULL AND NOT isnan(px) AND px <> 0""")
def q_nonzero_series(spark, sf):
    return T.nonzero_series(X.series(spark, sf))


@register("min_history", """
SELECT tk, dt, px FROM (SELECT *, count(*) OVER (PARTITION BY tk) AS n FROM series
                       WHERE dt < DATE '1998-01-01') s WHERE n >= 3""")
def q_min_history(spark, sf):
    return T.min_history(X.series(spark, sf), "1998-01-01", 3)


_WIN_SQL = f"""
WITH f AS (
  SELECT tk, dt, px,
         row_number() OVER ({W}) - 1 AS i,
         count(*) OVER (PARTITION BY tk) AS n,
         lag(dt, 275) OVER ({W}) AS start_dt,
         max(px) OVER ({W} RANGE BETWEEN CURRENT ROW AND 8 FOLLOWING) AS week_max,
         max(px) OVER ({W} RANGE BETWEEN CURRENT ROW AND 31 FOLLOWING) AS month_max
  FROM series),
w AS (
  SELECT tk, CAST((i - 275) // 75 AS INTEGER) AS window_no, start_dt, dt AS end_dt, px, week_max, month_max,
         (week_max - px) / px * 100.0 AS week_gain, (month_max - px) / px * 100.0 AS month_gain, i, n
  FROM f
  WHERE i >= 275 AND (i - 275) % 75 = 0
    AND CASE WHEN (i - 275) // 75 = 0 THEN n > 275 ELSE n > 75 * ((i - 275) // 75) - 75 + 550 END)
"""


@register("count_windows", _WIN_SQL + "SELECT tk, window_no, start_dt, end_dt, px FROM w")
def q_count_windows(spark, sf):
    return T.count_windows(X.series(spark, sf))


@register("forward_labels", _WIN_SQL + """
SELECT tk, window_no, start_dt, end_dt, px, week_max, round(week_gain, 6) AS week_gain,
       month_max, round(month_gain, 6) AS month_gain FROM w""")
def q_forward_labels(spark, sf):
    df = T.forward_labels(X.series(spark, sf))
    return df.withColumn("week_gain", F.round("week_gain", 6)).withColumn("month_gain", F.round("month_gain", 6))


@register("window_vectors", f"""
WITH f AS (SELECT tk, dt, px, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY tk) AS n FROM series),
g AS (SELECT *, CASE WHEN n <= 275 THEN 0 ELSE greatest(1, floor((n - 550 + 74) / 75) + 1) END AS nwin FROM f),
k AS (SELECT tk, dt, px, i, unnest(range(CAST(greatest(0, ceil((i - 274) / 75)) AS BIGINT),
                                        CAST(least(floor(i / 75), nwin - 1) + 1 AS BIGINT))) AS window_no FROM g)
SELECT tk, CAST(window_no AS INTEGER) AS window_no, CAST(i - window_no * 75 AS INTEGER) AS pos, dt, px FROM k""")
def q_window_vectors(spark, sf):
    return T.window_points(X.series(spark, sf))


_LADDER_SQL = _WIN_SQL + """,
lab AS (
  SELECT tk, window_no, end_dt, CASE WHEN month_gain < 50 THEN ['Month-Underperform']
         ELSE list_filter(['Month50', CASE WHEN month_gain > 70 THEN 'Month70' END,
                           CASE WHEN month_gain > 90 THEN 'Month90' END], lambda x: x IS NOT NULL) END
      || CASE WHEN week_gain < 20 THEN ['Week-Underperform']
         ELSE list_filter(['Week20', CASE WHEN week_gain > 30 THEN 'Week30' END, CASE WHEN week_gain > 40 THEN 'Week40' END,
                           CASE WHEN week_gain > 50 THEN 'Week50' END, CASE WHEN week_gain > 60 THEN 'Week60' END],
                          lambda x: x IS NOT NULL) END AS labels
  FROM w)
SELECT tk, window_no, end_dt, unnest(labels) AS bucket FROM lab"""


@register("bucket_ladder", _LADDER_SQL)
def q_bucket_ladder(spark, sf):
    w = T.forward_labels(X.series(spark, sf))
    return T.bucket_ladder(w).select("tk", "window_no", "end_dt", "bucket")


# the same over long series: some 26 windows a ticker
_long = lambda sql: sql.replace("FROM series", "FROM nation_series")


@register("long_windows", _long(_WIN_SQL) + """
SELECT tk, window_no, start_dt, end_dt, px, week_max, round(week_gain, 6) AS week_gain, month_max, round(month_gain, 6) AS month_gain FROM w""")
def q_long_windows(spark, sf):
    df = T.forward_labels(X.nation_series(spark, sf))
    return df.withColumn("week_gain", F.round("week_gain", 6)).withColumn("month_gain", F.round("month_gain", 6))


@register("capped_windows", _long(_WIN_SQL) + "SELECT tk, window_no, start_dt, end_dt, px FROM w WHERE window_no < 5")
def q_capped_windows(spark, sf):
    """At most five windows a ticker."""
    return T.count_windows(X.nation_series(spark, sf), cap=5)


@register("labelled_sink", _long(_LADDER_SQL).replace("SELECT tk, window_no, end_dt, unnest(labels) AS bucket FROM lab", """,
b AS (SELECT tk, window_no, end_dt, unnest(labels) AS bucket FROM lab)
SELECT b.tk, b.window_no, b.end_dt, b.bucket, count(*) AS n, arg_min(f.px, f.i) AS first_px, arg_max(f.px, f.i) AS last_px, round(sum(f.px), 6) AS sum_px
FROM b JOIN f ON b.tk = f.tk AND f.i >= 75 * b.window_no AND f.i < 75 * b.window_no + 275 GROUP BY b.tk, b.window_no, b.end_dt, b.bucket"""))
def q_labelled_sink(spark, sf):
    """Window arrays written to one directory per label, and what the directories hold."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tessera-windows-{uuid.uuid4().hex}"
    out = T.labelled_windows(X.nation_series(spark, sf))
    write_table(out, path, partition_by=["bucket"])
    back = spark.read.schema(out.schema).parquet(path)
    at = lambda i: F.element_at("prices", i)
    return back.select("tk", "window_no", "end_dt", "bucket", F.size("prices").cast("bigint").alias("n"), at(1).alias("first_px"), at(-1).alias("last_px"),
                       F.round(F.aggregate("prices", F.lit(0.0), lambda a, x: a + x), 6).alias("sum_px"))


@register("unpivot_from_sixth", f"""
SELECT dt, tk, px FROM (UNPIVOT prices_wide ON {", ".join(f"n{n:02d}" for n in range(5, 25))} INTO NAME tk VALUE px) WHERE px IS NOT NULL""")
def q_unpivot_from_sixth(spark, sf):
    """The leading columns of the matrix (the date is the first of six) are skipped."""
    wide = X.prices_wide(spark, sf)
    return T.unpivot_prices(wide, tickers=wide.columns[6:])


@register("shuffle_tickers", f"""
SELECT tk, n_days, row_number() OVER (ORDER BY {sql_uniform('42', 'tk')}, tk) AS pos FROM (SELECT tk, count(*) AS n_days FROM nation_series GROUP BY tk) t""")
def q_shuffle_tickers(spark, sf):
    return shuffle(X.nation_series(spark, sf).groupBy("tk").agg(F.count(F.lit(1)).alias("n_days")), "tk", 42)


@register("bucket_exclusive", _WIN_SQL + """
SELECT tk, window_no, end_dt,
  CASE WHEN month_gain < 50 THEN 'Month<50' WHEN month_gain < 70 THEN 'Month<70' WHEN month_gain < 90 THEN 'Month<90'
       WHEN month_gain IS NOT NULL THEN 'Month>=90' END AS month_bucket,
  CASE WHEN week_gain < 20 THEN 'Week<20' WHEN week_gain < 30 THEN 'Week<30' WHEN week_gain < 40 THEN 'Week<40'
       WHEN week_gain < 50 THEN 'Week<50' WHEN week_gain < 60 THEN 'Week<60'
       WHEN week_gain IS NOT NULL THEN 'Week>=60' END AS week_bucket
FROM w""")
def q_bucket_exclusive(spark, sf):
    w = T.forward_labels(X.series(spark, sf))
    return w.select("tk", "window_no", "end_dt",
                    T.exclusive_bucket("month_gain", T.MONTH_RUNGS, "Month").alias("month_bucket"),
                    T.exclusive_bucket("week_gain", T.WEEK_RUNGS, "Week").alias("week_bucket"))


@register("pct_change", f"""
SELECT tk, dt, px, (round_even(((px - lag(px) OVER ({W})) / lag(px) OVER ({W}) * 100.0) * 100.0, 0) / 100.0 + 0.0) + 0.0 AS pct FROM series""")
def q_pct_change(spark, sf):
    from pyspark.sql import Window
    s = X.series(spark, sf)
    prev = F.lag("px").over(Window.partitionBy("tk").orderBy(F.unix_date("dt")))
    return s.select("tk", "dt", "px", pct_change(prev, "px", 2).alias("pct"))


@register("trailing_window", f"""
SELECT tk, dt, px, count(px) OVER ({W} RANGE BETWEEN 1825 PRECEDING AND CURRENT ROW) AS n_days,
       min(px) OVER ({W} RANGE BETWEEN 1825 PRECEDING AND CURRENT ROW) AS lo,
       max(px) OVER ({W} RANGE BETWEEN 1825 PRECEDING AND CURRENT ROW) AS hi,
       (round_even((avg(px) OVER ({W} RANGE BETWEEN 1825 PRECEDING AND CURRENT ROW)) * 10000.0, 0) / 10000.0 + 0.0) AS mean
FROM series""")
def q_trailing_window(spark, sf):
    return T.trailing_window(X.series(spark, sf))


@register("sma", f"""
SELECT tk, dt, px,
  CASE WHEN row_number() OVER ({W}) - 1 >= 26 THEN (round_even((avg(px) OVER ({W} ROWS BETWEEN 26 PRECEDING AND CURRENT ROW)) * 100.0, 0) / 100.0 + 0.0) END AS sma26,
  CASE WHEN row_number() OVER ({W}) - 1 >= 12 THEN (round_even((avg(px) OVER ({W} ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)) * 100.0, 0) / 100.0 + 0.0) END AS sma12
FROM series""")
def q_sma(spark, sf):
    return T.sma(X.series(spark, sf), [26, 12])


@register("bollinger", f"""
WITH b AS (SELECT tk, dt, px, row_number() OVER ({W}) - 1 AS i,
  (round_even((avg(px) OVER ({W} ROWS BETWEEN 26 PRECEDING AND CURRENT ROW)) * 100.0, 0) / 100.0 + 0.0) AS m,
  stddev_pop(px) OVER ({W} ROWS BETWEEN 26 PRECEDING AND CURRENT ROW) AS sd FROM series)
SELECT tk, dt, px, CASE WHEN i >= 26 THEN m END AS sma,
  CASE WHEN i >= 26 THEN (round_even((m + 2.0 * sd) * 100.0, 0) / 100.0 + 0.0) END AS upper,
  CASE WHEN i >= 26 THEN (round_even((m - 2.0 * sd) * 100.0, 0) / 100.0 + 0.0) END AS lower FROM b""")
def q_bollinger(spark, sf):
    return T.bollinger(X.series(spark, sf))


@register("rsi", f"""
WITH c AS (SELECT tk, dt, px, row_number() OVER ({W}) - 1 AS i, px - lag(px) OVER ({W}) AS chg FROM series),
m AS (SELECT tk, dt, px, i,
  sum(greatest(chg, 0.0)) OVER ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) / 12.0 AS au,
  sum(greatest(-chg, 0.0)) OVER ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) / 12.0 AS ad FROM c)
SELECT tk, dt, px, CASE WHEN i >= 12 THEN
  CASE WHEN ad = 0 THEN CASE WHEN au > 0 THEN 100.0 END ELSE (round_even((100.0 - 100.0 / (1.0 + au / ad)) * 100.0, 0) / 100.0 + 0.0) END END AS rsi
FROM m""")
def q_rsi(spark, sf):
    return T.rsi(X.series(spark, sf))


def _ema_sql(w: int) -> str:
    a = f"(2.0 / {w + 1})"
    return f"""
e{w}(tk, i, ema) AS (
  SELECT tk, i, (round_even((px * {a} + (round_even((s{w} / {w + 1}) * 100.0, 0) / 100.0 + 0.0) * (1 - {a})) * 100.0, 0) / 100.0 + 0.0) FROM s WHERE i = {w}
  UNION ALL
  SELECT s.tk, s.i, (round_even((s.px * {a} + e{w}.ema * (1 - {a})) * 100.0, 0) / 100.0 + 0.0) FROM e{w} JOIN s ON s.tk = e{w}.tk AND s.i = e{w}.i + 1)"""


_EMA_BASE = f"""
WITH RECURSIVE s AS (SELECT tk, dt, px, row_number() OVER ({W}) - 1 AS i,
   sum(px) OVER ({W} ROWS BETWEEN 26 PRECEDING AND CURRENT ROW) AS s26,
   sum(px) OVER ({W} ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS s12 FROM series),
{_ema_sql(26)},
{_ema_sql(12)}
"""


@register("ema", _EMA_BASE + """
SELECT s.tk, s.dt, s.px, e26.ema AS ema26, e12.ema AS ema12 FROM s
LEFT JOIN e26 ON s.tk = e26.tk AND s.i = e26.i LEFT JOIN e12 ON s.tk = e12.tk AND s.i = e12.i""")
def q_ema(spark, sf):
    return T.ema(X.series(spark, sf), (26, 12))


@register("macd", _EMA_BASE + """
SELECT s.tk, s.dt, s.px, (round_even((e26.ema - e12.ema) * 100.0, 0) / 100.0 + 0.0) + 0.0 AS macd FROM s
LEFT JOIN e26 ON s.tk = e26.tk AND s.i = e26.i LEFT JOIN e12 ON s.tk = e12.tk AND s.i = e12.i""")
def q_macd(spark, sf):
    return T.macd(X.series(spark, sf))


_BACK_SQL = f"""
WITH last AS (SELECT tk, min(dt) AS first_dt, max(dt) AS last_dt, arg_max(px, dt) AS current FROM series GROUP BY tk),
both_s AS (SELECT s.tk, s.dt, s.px, i.sp FROM series s JOIN index_series i USING (dt)),
tg AS (SELECT tk, z, CASE WHEN z % 2 = 0 THEN CAST(last_dt - INTERVAL 12 MONTH + days * INTERVAL 1 DAY AS DATE)
                          ELSE CAST(last_dt - INTERVAL 12 MONTH - days * INTERVAL 1 DAY AS DATE) END AS target
       FROM last, {_sql_offsets(BACK_OFFSETS)}),
bk AS (SELECT tg.tk, tg.z, tg.target, b.dt AS m_dt, b.px, b.sp FROM tg ASOF LEFT JOIN both_s b
       ON tg.tk = b.tk AND tg.target >= b.dt),
bm AS (SELECT tk, z, target, CASE WHEN m_dt >= target - 6 THEN m_dt END AS match_dt,
                CASE WHEN m_dt >= target - 6 THEN px END AS px, CASE WHEN m_dt >= target - 6 THEN sp END AS sp FROM bk),
bs AS (SELECT tk, min(z) AS stop FROM bm JOIN last USING (tk) WHERE match_dt IS NULL AND target - 6 < first_dt GROUP BY tk),
back AS (SELECT bm.* FROM bm LEFT JOIN bs USING (tk) WHERE stop IS NULL OR z < stop)
"""


def _fwd_sql(name, offs):
    return f"""
{name}_a AS (SELECT tk, first_dt, z AS b, CAST(last_dt - days * INTERVAL 1 DAY AS DATE) AS target FROM last, {_sql_offsets(offs)}
             WHERE CAST(last_dt - days * INTERVAL 1 DAY AS DATE) > DATE '2000-03-18'),
{name}_s AS (SELECT tk, min(b) AS stop FROM {name}_a WHERE target < first_dt GROUP BY tk),
{name}_t AS (SELECT a.tk, a.b, a.target FROM {name}_a a LEFT JOIN {name}_s s USING (tk) WHERE s.stop IS NULL OR a.b < s.stop),
{name}_j AS (SELECT t.tk, t.b, t.target, s.dt AS m_dt, s.px FROM {name}_t t ASOF LEFT JOIN series s
             ON t.tk = s.tk AND t.target <= s.dt),
{name} AS (SELECT tk, b, target, CASE WHEN m_dt <= target + 9 THEN m_dt END AS match_dt,
                  CASE WHEN m_dt <= target + 9 THEN px END AS px FROM {name}_j)"""


@register("asof_backward", _BACK_SQL + "SELECT tk, z, target, match_dt, px, sp FROM back")
def q_asof_backward(spark, sf):
    return R.backward_samples(X.series(spark, sf), X.index_series(spark, sf), BACK_OFFSETS) \
            .withColumnRenamed("match_dt", "match_dt")


@register("asof_forward", _BACK_SQL + "," + _fwd_sql("far", FAR_OFFSETS) + " SELECT tk, b, target, match_dt, px FROM far")
def q_asof_forward(spark, sf):
    return R.forward_samples(X.series(spark, sf), FAR_OFFSETS)


@register("prior_avgs", _BACK_SQL + "," + _fwd_sql("far", FAR_OFFSETS) + "," + _fwd_sql("rec", RECENT_OFFSETS) + """
SELECT t.tk, round(b.prior, 9) AS prior, round(b.sp_prior, 9) AS sp_prior, f.far_avg, r.recent_avg
FROM (SELECT DISTINCT tk FROM series) t
LEFT JOIN (SELECT tk, avg(px) AS prior, avg(sp) AS sp_prior FROM back GROUP BY tk) b USING (tk)
LEFT JOIN (SELECT tk, (round_even((avg(px)) * 100.0, 0) / 100.0 + 0.0) AS far_avg FROM far GROUP BY tk) f USING (tk)
LEFT JOIN (SELECT tk, (round_even((avg(px)) * 100.0, 0) / 100.0 + 0.0) AS recent_avg FROM rec GROUP BY tk) r USING (tk)""")
def q_prior_avgs(spark, sf):
    p = R.prior_averages(X.series(spark, sf), X.index_series(spark, sf), BACK_OFFSETS, FAR_OFFSETS,
                         RECENT_OFFSETS)
    return p.select("tk", F.round("prior", 9).alias("prior"), F.round("sp_prior", 9).alias("sp_prior"),
                    "far_avg", "recent_avg")


@register("prior_year_return", _BACK_SQL + """,
j AS (SELECT l.tk, l.last_dt, l.current, i.sp AS sp_current, b.prior, b.sp_prior FROM last l
      LEFT JOIN index_series i ON i.dt = l.last_dt
      LEFT JOIN (SELECT tk, avg(px) AS prior, avg(sp) AS sp_prior FROM back GROUP BY tk) b USING (tk))
SELECT tk, last_dt, current, sp_current, (round_even(((current - prior) / prior * 100.0) * 100.0, 0) / 100.0 + 0.0) AS year_prior_diff,
       (round_even(((sp_current - sp_prior) / sp_prior * 100.0) * 100.0, 0) / 100.0 + 0.0) AS sp_year_prior,
       (round_even(((current - prior) / prior * 100.0) * 100.0, 0) / 100.0 + 0.0) - (round_even(((sp_current - sp_prior) / sp_prior * 100.0) * 100.0, 0) / 100.0 + 0.0)
         AS outperformance
FROM j""")
def q_prior_year_return(spark, sf):
    return R.year_prior_return(X.series(spark, sf), X.index_series(spark, sf), BACK_OFFSETS)
