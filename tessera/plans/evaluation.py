"""Query keys for classification and regression evaluation
(SURVEY 2.2 P26, 2.3 J12, 2.4 G11-G15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import round_class, threshold_class
from tessera.operators import stats as S
from tessera.plans import fixtures as X
from tessera.plans.registry import register

R = 9   # digits kept for order-dependent float aggregates (cross-engine comparison)


@register("threshold_class", """
SELECT id, p, CAST(p > 0.6::DOUBLE AS INTEGER) AS cls_60, CAST(p > 0.5::DOUBLE AS INTEGER) AS cls_50,
       CAST(round_even(p, 0) AS INTEGER) AS cls_round FROM scores""")
def q_threshold_class(spark, sf):
    s = X.scores(spark, sf)
    return s.select("id", "p", threshold_class("p", 0.6).alias("cls_60"), threshold_class("p", 0.5).alias("cls_50"),
                    round_class("p").alias("cls_round"))


@register("confusion", """
WITH c AS (SELECT t, count_if(p > t AND y = 1) AS tp, count_if(p > t AND y <> 1) AS fp,
                  count_if(NOT p > t AND y <> 1) AS tn, count_if(NOT p > t AND y = 1) AS fn
           FROM scores, (VALUES (0.5::DOUBLE), (0.6::DOUBLE)) th(t) GROUP BY t)
SELECT t AS threshold, tp, fp, tn, fn, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
       coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM c""")
def q_confusion(spark, sf):
    s = X.scores(spark, sf).withColumn("threshold", F.explode(F.array(F.lit(0.5), F.lit(0.6))))
    return S.confusion(s, "y", "p", F.col("threshold"), ["threshold"])


@register("regression_metrics", f"""
SELECT count(*) AS n, round(avg(abs(y - yhat)), {R}) AS mae, round(avg((y - yhat) * (y - yhat)), {R}) AS mse,
       round(sqrt(avg((y - yhat) * (y - yhat))), {R}) AS rmse,
       round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), {R}) AS r2,
       round(avg(yhat - y), {R}) AS mean_error FROM preds""")
def q_regression_metrics(spark, sf):
    m = S.regression_metrics(X.preds(spark, sf), "y", "yhat")
    return m.select("n", *[F.round(c, R).alias(c) for c in ("mae", "mse", "rmse", "r2", "mean_error")])


@register("fit_line", f"SELECT round(regr_slope(yhat, y), {R}) AS slope, round(regr_intercept(yhat, y), {R}) AS intercept FROM preds")
def q_fit_line(spark, sf):
    f = S.fit_line(X.preds(spark, sf), "y", "yhat")
    return f.select(F.round("slope", R).alias("slope"), F.round("intercept", R).alias("intercept"))


@register("pearson", f"SELECT round(corr(y, yhat), {R}) AS pearson FROM preds")
def q_pearson(spark, sf):
    return S.pearson(X.preds(spark, sf), "y", "yhat").select(F.round("pearson", R).alias("pearson"))


@register("spearman", f"""
WITH r AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rx,
                  rank() OVER (ORDER BY yhat) + (count(*) OVER (PARTITION BY yhat) - 1) / 2.0 AS ry FROM preds)
SELECT round(corr(rx, ry), {R}) AS spearman FROM r""")
def q_spearman(spark, sf):
    return S.spearman(X.preds(spark, sf), "y", "yhat").select(F.round("spearman", R).alias("spearman"))


@register("residuals", "SELECT id, y, yhat, y - yhat AS error FROM preds")
def q_residuals(spark, sf):
    return X.preds(spark, sf).withColumn("error", F.col("y") - F.col("yhat"))
