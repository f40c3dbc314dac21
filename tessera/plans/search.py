"""Query keys for trial grids, random search, best trial, run names and the
parameter lookup (SURVEY 2.9 M5/M6, 2.4 G20, 2.2 P30/P32).  Trials are
evaluated over the ``scores`` table, so every key scans data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import search as SE
from tessera.operators import timeseries as T
from tessera.plans import fixtures as X
from tessera.plans.prices import _LADDER_SQL
from tessera.plans.registry import register

GRID = SE.param_grid(threshold=[0.4, 0.5, 0.6, 0.7], weight=[0.25, 0.5, 0.75])
SPACE = {"threshold": ("uniform", 0.3, 0.8), "weight": ("quniform", 0.0, 1.0, 0.05)}
RANDOM = SE.param_random(SPACE, 200, seed=42)


def _values_sql(trials) -> str:
    keys = list(trials[0].keys())
    rows = ", ".join("(" + ", ".join(f"{t[k]!r}::DOUBLE" if isinstance(t[k], float) else str(t[k]) for k in keys) + ")"
                     for t in trials)
    return f"(VALUES {rows}) t({', '.join(keys)})"


def _eval_sql(trials) -> str:
    return f"""
ev AS (SELECT trial, threshold, weight, count_if(p > threshold AND y = 1) AS tp, count_if(p > threshold AND y <> 1) AS fp,
              count_if(NOT p > threshold AND y <> 1) AS tn, count_if(NOT p > threshold AND y = 1) AS fn
       FROM scores, {_values_sql(trials)} GROUP BY trial, threshold, weight),
res AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
               weight * coalesce(tp / nullif(tp + fn, 0), 0.0) + (1.0 - weight) * coalesce(tp / nullif(tp + fp, 0), 0.0)
                 AS objective FROM ev)"""


@register("param_grid", f"WITH {_eval_sql(GRID)} SELECT * FROM res")
def q_param_grid(spark, sf):
    return SE.evaluate_thresholds(X.scores(spark, sf), GRID)


@register("param_random", f"WITH {_eval_sql(RANDOM)} SELECT * FROM res")
def q_param_random(spark, sf):
    return SE.evaluate_thresholds(X.scores(spark, sf), RANDOM)


@register("best_trial", f"""WITH {_eval_sql(GRID)}
SELECT * FROM res WHERE objective = (SELECT max(objective) FROM res)
  AND trial = (SELECT min(trial) FROM res WHERE objective = (SELECT max(objective) FROM res))""")
def q_best_trial(spark, sf):
    return SE.best_trial(SE.evaluate_thresholds(X.scores(spark, sf), GRID), "objective", "max")


@register("run_name", f"""WITH {_eval_sql(GRID)}
SELECT trial, concat_ws('-', 'Threshold', CAST(threshold AS VARCHAR), CAST(weight AS VARCHAR)) AS run_name, objective FROM res""")
def q_run_name(spark, sf):
    t = SE.evaluate_thresholds(X.scores(spark, sf), GRID)
    return t.select("trial", SE.run_name("Threshold", "threshold", "weight").alias("run_name"), "objective")


_TABLE_SQL = "(VALUES " + ", ".join(f"('{a}', {b}, {c}, {d})" for a, b, c, d in SE.LAYER_TABLE) + \
             ") p(timeframe, threshold, layer_size, epochs)"


@register("param_lookup", _LADDER_SQL.replace("SELECT tk, window_no, end_dt, unnest(labels) AS bucket FROM lab", f"""
, b AS (SELECT tk, window_no, end_dt, unnest(labels) AS bucket FROM lab)
SELECT b.tk, b.window_no, b.end_dt, b.bucket, b.timeframe, b.threshold, p.layer_size, p.epochs FROM
  (SELECT *, regexp_extract(bucket, '^(Week|Month)', 1) AS timeframe,
          TRY_CAST(regexp_extract(bucket, '([0-9]+)$', 1) AS INTEGER) AS threshold FROM b) b
LEFT JOIN {_TABLE_SQL} USING (timeframe, threshold)"""))
def q_param_lookup(spark, sf):
    b = T.bucket_ladder(T.forward_labels(X.series(spark, sf))).select("tk", "window_no", "end_dt", "bucket")
    b = b.withColumn("timeframe", F.regexp_extract("bucket", "^(Week|Month)", 1)) \
         .withColumn("threshold", F.nullif(F.regexp_extract("bucket", "([0-9]+)$", 1), F.lit("")).cast("int"))
    return SE.param_lookup(b, "timeframe", "threshold")
