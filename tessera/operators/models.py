"""Modelling on Spark ML.

The reference's single-process networks are re-aimed at Spark ML estimators
that train with distributed iterative jobs over packed feature vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import matrix as M

PID = "patient_id"


def feature_vectors(cells: DataFrame, order: DataFrame | None = None, keys: Sequence[str] = (PID,)) -> DataFrame:
    """Long cells -> ``(keys..., features VECTOR)`` in feature-name order.

    Features holding any NULL cell are dropped first (the reference drops them)."""
    clean = M.drop_null(cells, "features")
    order = order if order is not None else M.feature_order(clean)
    rows = M.pack(clean, order, keys)
    return rows.select(*keys, array_to_vector("x").alias("features"))


class ElasticNet:
    """scikit-learn ``ElasticNet(alpha, l1_ratio)`` solved with Spark's ``LinearRegression``.

    Spark scales the whole penalty by the label's standard deviation while the
    scikit-learn objective only needs it on the L1 part, so the model is fitted
    on y/s (s = population std of y) with regParam = a*r/s + a*(1-r) and
    elasticNetParam = (a*r/s) / regParam, without feature standardisation, and
    predictions are scaled back by s.
    """

    def __init__(self, alpha: float = 0.4, l1_ratio: float = 0.5, max_iter: int = 10000, tol: float = 1e-8):
        self.alpha, self.l1_ratio, self.max_iter, self.tol = alpha, l1_ratio, max_iter, tol
        self.model = None
        self.scale = 1.0

    def fit(self, train: DataFrame, label: str = "y", features: str = "features") -> "ElasticNet":
        s = train.select(F.stddev_pop(label)).first()[0] or 1.0   # one number for the solver
        a, r = self.alpha, self.l1_ratio
        reg = a * r / s + a * (1 - r)
        enet = (a * r / s) / reg if reg > 0 else 0.0
        lr = LinearRegression(featuresCol=features, labelCol="_ys", regParam=reg, elasticNetParam=enet,
                              standardization=False, maxIter=self.max_iter, tol=self.tol)
        self.model = lr.fit(train.withColumn("_ys", F.col(label) / F.lit(s)))
        self.scale = s
        return self

    @property
    def coefficients(self):
        return self.model.coefficients.toArray() * self.scale

    @property
    def intercept(self) -> float:
        return self.model.intercept * self.scale

    def transform(self, df: DataFrame, out: str = "yhat") -> DataFrame:
        pred = self.model.transform(df)
        return pred.withColumn(out, F.col("prediction") * F.lit(self.scale)).drop("prediction")


def classifier(features: str = "features", label: str = "label", reg: float = 0.01, elastic: float = 0.0,
               max_iter: int = 100) -> LogisticRegression:
    return LogisticRegression(featuresCol=features, labelCol=label, regParam=reg, elasticNetParam=elastic,
                              maxIter=max_iter)


def regressor(features: str = "features", label: str = "y", seed: int = 42) -> GBTRegressor:
    return GBTRegressor(featuresCol=features, labelCol=label, maxIter=20, maxDepth=3, seed=seed)


def positive_probability(pred: DataFrame, out: str = "p") -> DataFrame:
    return pred.withColumn(out, vector_to_array("probability")[1]) \
               .drop("rawPrediction", "probability", "prediction")


def grid(**lists: Sequence) -> list[dict]:
    """Cartesian product of parameter lists, in the order given (one dict per trial)."""
    out = [{}]
    for name, values in lists.items():
        out = [dict(t, **{name: v}) for t in out for v in values]
    return out


def grid_search(estimator, train: DataFrame, valid: DataFrame, param_maps: list[dict], evaluate,
                parallelism: int = 4) -> list[dict]:
    """Fit every configuration and score it on ``valid``; ``parallelism`` trials
    run as concurrent Spark jobs (the data is cached once and shared).

    ``evaluate(model, valid) -> dict`` returns the metrics of one trial."""
    from concurrent.futures import ThreadPoolExecutor
    train, valid = train.cache(), valid.cache()

    def run(pm):
        model = estimator.copy({estimator.getParam(k): v for k, v in pm.items()}).fit(train)
        return dict(pm, **evaluate(model, valid))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = list(pool.map(run, param_maps))
    train.unpersist()
    valid.unpersist()
    return rows


def sentiment_pipeline(text: str = "text", label: str = "label", num_features: int = 1 << 16) -> Pipeline:
    """Hashed term counts and a multinomial naive Bayes classifier: training is
    one aggregation pass over the documents (no per-iteration jobs)."""
    tok = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[\p{L}\p{N}]+", gaps=False, toLowercase=True)
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features)
    nb = NaiveBayes(featuresCol="_tf", labelCol=label, smoothing=1.0, modelType="multinomial")
    return Pipeline(stages=[tok, tf, nb])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
