"""Stacked logistic fits against single fits, optimality conditions and Spark's estimator."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import stacked as ST

CONFIGS = [(r, l) for r in (0.001, 0.01, 0.03, 0.1) for l in (0.0, 0.5, 1.0)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6)) * [1, 10, 0.1, 1, 5, 0] + [0, 100, 0, 3, 0, 7]
    y = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] * 1.5 - 0.2 * (x[:, 1] - 100) + 1)))).astype(int)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, label int").repartition(4).cache()
    return df, x, y


def test_all_configurations_at_once_equal_single_fits(data):
    df, x, y = data
    stacked = ST.fit_logistic(df, CONFIGS)
    for i in (0, 4, 11):
        assert np.abs(ST.fit_logistic(df, [CONFIGS[i]])[0] - stacked[i]).max() < 1e-7
    bounded = ST.fit_logistic(df, CONFIGS[-3:], tol=1e-7, curvatures=0)  # the bound instead of curvatures
    assert np.abs(bounded[:, 1:] * x.std(axis=0) - stacked[-3:, 1:] * x.std(axis=0)).max() < 1e-4
    std = x.std(axis=0, ddof=1)
    for (reg, ratio), c in zip(CONFIGS, stacked):
        assert c[-1] == 0                                             # the constant feature
        b = c[1:6] * std[:5]
        p = 1 / (1 + np.exp(-(c[0] + x @ c[1:])))
        slope = ((y - p) @ ((x - x.mean(axis=0))[:, :5] / std[:5])) / len(y) - reg * (1 - ratio) * b
        off = np.where(b != 0, np.abs(slope - reg * ratio * np.sign(b)), np.maximum(np.abs(slope) - reg * ratio, 0))
        assert off.max() < 1e-7 and abs((y - p).mean()) < 1e-7


def test_equals_sparks_estimator(data):
    df, _, _ = data
    for reg, ratio in ((0.01, 0.0), (0.03, 0.5)):
        model = LogisticRegression(regParam=reg, elasticNetParam=ratio, maxIter=500, tol=1e-12, labelCol="label", featuresCol="v") \
            .fit(df.withColumn("v", array_to_vector("x")))
        own = ST.fit_logistic(df, [(reg, ratio)])[0]
        assert np.abs(own[1:] - model.coefficients.toArray()).max() < 1e-4 and abs(own[0] - model.intercept) < 1e-2


def test_scores_of_all_models_in_one_scan(data):
    df, x, y = data
    coefs = ST.fit_logistic(df, CONFIGS[:3])
    got = {r.config: r for r in ST.confusion_of_all(df, coefs, 0.6).collect()}
    for i, c in enumerate(coefs):
        said = 1 / (1 + np.exp(-(c[0] + x @ c[1:]))) > 0.6
        assert (got[i].tp, got[i].fp, got[i].tn, got[i].fn) == ((said & (y == 1)).sum(), (said & (y == 0)).sum(), (~said & (y == 0)).sum(), (~said & (y == 1)).sum())
        assert abs(got[i].accuracy - (said == y).mean()) < 1e-12
        shown = ST.probability(df, c).select(F.sum("p")).first()[0]
        assert abs(shown - (1 / (1 + np.exp(-(c[0] + x @ c[1:])))).sum()) < 1e-6


def test_one_class_is_refused(spark):
    with pytest.raises(ValueError, match="both classes"):
        ST.fit_logistic(spark.createDataFrame([([1.0], 1), ([2.0], 1)], "x array<double>, label int"), CONFIGS[:1])
