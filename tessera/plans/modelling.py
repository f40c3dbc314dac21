"""Query keys for model training and scoring on Spark ML (rows-only checks:
fitted models are iterative and not SQL-expressible).  SURVEY 2.9, 2.6 L8, 2.3 J13."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import balance as MD_B
from tessera.operators.adaptive import adaptive_search
from tessera.operators import models as MD
from tessera.operators import moments as MO
from tessera.operators import sampling as SM
from tessera.operators import stacked as ST
from tessera.operators import stats as S
from tessera.operators import text as TO
from tessera.operators.scaling import scaler_apply, scaler_fit
from tessera.plans import fixtures as X
from tessera.plans import modelprep as MP
from tessera.plans.registry import register
from tessera.session import cut_lineage


def _vectors(spark, sf):
    return MD.feature_vectors(X.cells(spark, sf))


def _reg_data(spark, sf):
    t = X.target(spark, sf).na.drop(subset=["y"])
    return _vectors(spark, sf).join(t, "patient_id")


SWEEPS = 120
ALPHAS = (0.05, 0.1, 0.2, 0.3, 0.4)


def _packed(spark, sf):
    """(patient_id, x, y): features without NULL cells in name order, patients with a target."""
    clean = MD.M.drop_null(X.cells(spark, sf), "features")
    return MD.M.pack(clean, MD.M.feature_order(clean)).join(X.target(spark, sf).na.drop(subset=["y"]), "patient_id")


ROWS_SQL = """bad AS (SELECT DISTINCT feature FROM cells WHERE beta IS NULL),
rowsx AS MATERIALIZED (SELECT patient_id, x, y FROM (SELECT patient_id, list(beta ORDER BY feature) AS x FROM cells
  WHERE feature NOT IN (SELECT feature FROM bad) GROUP BY patient_id) v JOIN target USING (patient_id) WHERE y IS NOT NULL),
fp AS (SELECT *, row_number() OVER (ORDER BY patient_id) - 1 AS p, count(*) OVER () AS n FROM rowsx),
folds AS MATERIALIZED (SELECT patient_id, x, y, CASE WHEN p < (n % 4) * (n // 4 + 1) THEN p // (n // 4 + 1)
  ELSE n % 4 + (p - (n % 4) * (n // 4 + 1)) // (n // 4) END AS fold FROM fp)"""


def _solve_sql(sets: str, alphas) -> str:
    """Coordinate descent in SQL: ``sets`` gives (s, patient_id) of every training set; ``fits`` holds (s, alpha, b0, b)."""
    return f"""sets AS ({sets}),
cellx AS MATERIALIZED (SELECT patient_id, y, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM rowsx),
gram AS MATERIALIZED (SELECT s, i, list(g ORDER BY j) AS g FROM (SELECT s, a.i, b.i AS j, covar_pop(a.v, b.v) AS g
  FROM cellx a JOIN cellx b USING (patient_id) JOIN sets USING (patient_id) GROUP BY s, a.i, b.i) q GROUP BY s, i),
cy AS (SELECT s, i, covar_pop(v, y) AS c, avg(v) AS m, avg(y) AS ym FROM cellx JOIN sets USING (patient_id) GROUP BY s, i),
mom AS MATERIALIZED (SELECT s, list(g ORDER BY i) AS g, list(c ORDER BY i) AS c, list(m ORDER BY i) AS m, any_value(ym) AS ym
  FROM gram JOIN cy USING (s, i) GROUP BY s),
cd(s, alpha, it, b) AS (
  SELECT s, alpha, 0, list_transform(c, lambda q: 0.0::DOUBLE) FROM mom, (SELECT unnest({[float(a) for a in alphas]}::DOUBLE[]) AS alpha) al
  UNION ALL
  SELECT s, alpha, it + 1, list_reduce(list_concat([b], list_transform(range(1, len(c) + 1), lambda j: [j::DOUBLE])), lambda acc, e:
    list_transform(range(1, len(c) + 1), lambda i: CASE WHEN i <> e[1] THEN acc[i] ELSE
      sign(c[i] - list_dot_product(g[i], acc) + g[i][i] * acc[i]) * greatest(abs(c[i] - list_dot_product(g[i], acc) + g[i][i] * acc[i]) - alpha * 0.5::DOUBLE, 0.0::DOUBLE)
      / (g[i][i] + alpha * 0.5::DOUBLE) END))
  FROM cd JOIN mom USING (s) WHERE it < {SWEEPS}),
fits AS MATERIALIZED (SELECT s, alpha, ym - list_dot_product(m, b) AS b0, b FROM cd JOIN mom USING (s) WHERE it = {SWEEPS})"""


CV_SETS = "SELECT k AS s, patient_id FROM folds, range(0, 4) r(k) WHERE fold <> k"
HOLD_OUT_SQL = """hold AS MATERIALIZED (SELECT patient_id, CASE WHEN pos <= ceil(n * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT patient_id, row_number() OVER (ORDER BY """ + MP._u("patient_id") + """, patient_id) AS pos, count(*) OVER () AS n FROM rowsx) h)"""
TRAIN_SET = "SELECT -1 AS s, patient_id FROM hold WHERE split = 'train'"


@register("elastic_net", f"""WITH RECURSIVE {ROWS_SQL}, {HOLD_OUT_SQL}, {_solve_sql(TRAIN_SET, [0.4])}
SELECT patient_id, split, y, round(b0 + list_dot_product(x, b), 7) AS yhat FROM rowsx JOIN hold USING (patient_id), fits""")
def q_elastic_net(spark, sf):
    data = cut_lineage(SM.split3(_packed(spark, sf), "patient_id", 0.1, None, MP.SEED))
    fit = MO.path(MO.fold_moments(data.filter(F.col("split") == "train"), F.lit(0)).without(), [0.4])[0.4]
    return MO.predict(data, fit).select("patient_id", "split", "y", F.round("yhat", 7).alias("yhat"))


@register("cv_elastic_path", f"""WITH RECURSIVE {ROWS_SQL}, {_solve_sql(CV_SETS, ALPHAS)},
names AS (SELECT feature, row_number() OVER (ORDER BY feature) AS i FROM (SELECT DISTINCT feature FROM cells WHERE feature NOT IN (SELECT feature FROM bad)) d),
terms AS (SELECT s, alpha, '(intercept)' AS term, b0 AS coef FROM fits UNION ALL
          SELECT s, alpha, feature, b[i] FROM fits, names WHERE b[i] <> 0)
SELECT CAST(s AS INTEGER) AS fold, alpha, term, round(coef, 7) AS coef FROM terms""")
def q_cv_elastic_path(spark, sf):
    """Intercept and coefficients that are not 0, of every fold at every penalty."""
    clean = MD.M.drop_null(X.cells(spark, sf), "features")
    order = cut_lineage(MD.M.feature_order(clean))
    rows = MD.M.pack(clean, order).join(X.target(spark, sf).na.drop(subset=["y"]), "patient_id")
    fits = MO.cross_validate(cut_lineage(SM.kfold_ids(rows, ["patient_id"], 4)), ALPHAS)
    terms = fits.select("fold", "alpha", F.posexplode("coef").alias("at", "coef")).filter((F.col("at") == 0) | (F.col("coef") != 0))
    return terms.join(order, F.col("at") - 1 == F.col("pos"), "left").select(
        "fold", "alpha", F.coalesce("feature", F.lit("(intercept)")).alias("term"), F.round("coef", 7).alias("coef"))


SEARCH = {"alpha": ("uniform", 0.001, 0.5), "l1_ratio": ("uniform", 0.0, 1.0)}


@register("adaptive_search")
def q_adaptive_search(spark, sf):
    """200 cross-validated elastic nets in rounds of 20, all from one scan for the folds' cross products."""
    moments = MO.fold_moments(cut_lineage(SM.kfold_ids(_packed(spark, sf), ["patient_id"], 4)))
    trials = adaptive_search(SEARCH, lambda ts: [MO.cross_validated_mse(moments, t["alpha"], t["l1_ratio"]) for t in ts], 200, 20, MP.SEED)
    rows = [(t["trial"], t["round"], t["alpha"], t["l1_ratio"], t["loss"]) for t in trials]
    return spark.createDataFrame(rows, "trial int, round int, alpha double, l1_ratio double, mse double")


CV_SQL = """cv AS (SELECT CAST(fold AS INTEGER) AS fold, alpha, -avg(abs(y - b0 - list_dot_product(x, b))) AS neg_mae
  FROM folds JOIN fits ON s = fold GROUP BY fold, alpha)"""


@register("cv_mae", f"""WITH RECURSIVE {ROWS_SQL}, {_solve_sql(CV_SETS, [0.3])}, {CV_SQL} SELECT fold, round(neg_mae, 7) AS neg_mae FROM cv""")
def q_cv_mae(spark, sf):
    return _cv_neg_mae(_packed(spark, sf)).select("fold", F.round("neg_mae", 7).alias("neg_mae"))


def _cv_neg_mae(data):
    """(fold, neg_mae) of four contiguous folds."""
    folds = cut_lineage(SM.kfold_ids(data, ["patient_id"], 4))
    return MO.cross_validate(folds, [0.3]).select("fold", (-F.col("mae")).alias("neg_mae"))


def _class_data(spark, sf):
    """(patient_id, x, label, split), checkpointed: one packed row per labelled patient."""
    clean = MD.M.drop_null(X.cells(spark, sf), "features")
    data = MD.M.pack(clean, MD.M.feature_order(clean)).join(MP._lab(spark, sf), "patient_id")
    return cut_lineage(SM.split3(data, "patient_id", 0.2, 0.2, MP.SEED))


CLASS_ROWS_SQL = """bad AS (SELECT DISTINCT feature FROM cells WHERE beta IS NULL),
clx AS MATERIALIZED (SELECT patient_id, x, label, split FROM (SELECT patient_id, list(beta ORDER BY feature) AS x FROM cells
  WHERE feature NOT IN (SELECT feature FROM bad) GROUP BY patient_id) v JOIN split USING (patient_id))"""


def _logistic_sql(configs, train: str = "SELECT patient_id, x, label FROM clx WHERE split = 'train'", rounds: int = 250) -> str:
    """The same bounded steps in SQL: ``models`` holds (config, reg, ratio, b0, b) in the features' own units."""
    rows = ", ".join(f"({i}, {reg!r}::DOUBLE, {ratio!r}::DOUBLE)" for i, (reg, ratio) in enumerate(configs))
    entry = "(w[i] - list_dot_product(c4[i], acc) + c4[i][i] * acc[i])"
    sweep = f"""list_reduce(list_concat([{{b}}], list_transform(range(1, len(w) + 1), lambda j: [j::DOUBLE])), lambda acc, e:
      list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i <> e[1] THEN acc[i] ELSE
        sign({entry}) * greatest(abs({entry}) - reg * ratio, 0.0::DOUBLE) / (c4[i][i] + reg * (1 - ratio)) END))"""
    return f"""tr AS MATERIALIZED ({train}),
trx AS (SELECT patient_id, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM tr),
fs AS MATERIALIZED (SELECT i, avg(v) AS m, stddev_samp(v) AS s FROM trx GROUP BY i),
zx AS MATERIALIZED (SELECT patient_id, label, i, (v - m) / s AS z FROM trx JOIN fs USING (i)),
zr AS MATERIALIZED (SELECT patient_id, label, list(z ORDER BY i) AS z FROM zx GROUP BY patient_id, label),
zc AS MATERIALIZED (SELECT list(z ORDER BY i) AS zc FROM (SELECT i, list(z ORDER BY patient_id) AS z FROM zx GROUP BY i) q),
c4 AS MATERIALIZED (SELECT list(g ORDER BY i) AS c4 FROM (SELECT i, list(g ORDER BY j) AS g FROM
  (SELECT a.i, b.i AS j, covar_pop(a.z, b.z) / 4 AS g FROM zx a JOIN zx b USING (patient_id) GROUP BY a.i, b.i) q GROUP BY i) r),
cfg(config, reg, ratio) AS (VALUES {rows}),
lr(config, reg, ratio, it, b0, b) AS (
  SELECT config, reg, ratio, 0, (SELECT ln(avg(label) / (1 - avg(label))) FROM tr), list_transform(zc, lambda q: 0.0::DOUBLE) FROM cfg, zc
  UNION ALL
  SELECT config, reg, ratio, it + 1, b0, {sweep.format(b="b1")} FROM (SELECT *, {sweep.format(b="b")} AS b1 FROM
    (SELECT config, reg, ratio, it, b0 - 4 * list_avg(r) AS b0, b, c4,
            list_transform(range(1, len(b) + 1), lambda i: list_dot_product(c4[i], b) - list_dot_product(zc[i], r) / len(r)) AS w
     FROM (SELECT config, any_value(reg) AS reg, any_value(ratio) AS ratio, any_value(it) AS it, any_value(b0) AS b0, any_value(b) AS b,
                  list(1 / (1 + exp(-(b0 + list_dot_product(z, b)))) - label ORDER BY patient_id) AS r
           FROM lr, zr WHERE it < {rounds} GROUP BY config) g, zc, c4) h) k),
ms AS (SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM fs),
models AS MATERIALIZED (SELECT config, reg, ratio, b0 - list_sum(list_transform(range(1, len(b) + 1), lambda i: b[i] / s[i] * m[i])) AS b0,
  list_transform(range(1, len(b) + 1), lambda i: b[i] / s[i]) AS b FROM lr, ms WHERE it = {rounds})"""


_P = "1 / (1 + exp(-(b0 + list_dot_product(x, b))))"
CLASSIFIER = [(0.01, 0.0)]
GRID = [(reg, ratio) for reg in (0.001, 0.01, 0.03, 0.1) for ratio in (0.0, 0.5, 1.0)]


def _classified(spark, sf):
    data = _class_data(spark, sf)
    fit = ST.fit_logistic(data.filter(F.col("split") == "train"), CLASSIFIER)[0]
    return ST.probability(data.filter(F.col("split") != "train"), fit)


@register("classify", f"""WITH RECURSIVE {MP.LAB_SQL}, {MP.SPLIT_SQL}, {CLASS_ROWS_SQL}, {_logistic_sql(CLASSIFIER)}
SELECT patient_id, split, label, round({_P}, 6) AS p, CAST({_P} > 0.6::DOUBLE AS INTEGER) AS pred FROM clx, models WHERE split <> 'train'""")
def q_classify(spark, sf):
    return _classified(spark, sf).select("patient_id", "split", "label", F.round("p", 6).alias("p"), (F.col("p") > 0.6).cast("int").alias("pred"))


@register("regress")
def q_regress(spark, sf):
    data = SM.split3(_reg_data(spark, sf), "patient_id", 0.1, None, MP.SEED)
    model = MD.regressor().fit(data.filter(F.col("split") == "train"))
    return model.transform(data).select("patient_id", "split", "y", F.col("prediction").alias("yhat"))


@register("grid_search", f"""WITH RECURSIVE {MP.LAB_SQL}, {MP.SPLIT_SQL}, {CLASS_ROWS_SQL}, {_logistic_sql(GRID)},
c AS (SELECT reg, ratio, count_if({_P} > 0.5 AND label = 1) AS tp, count_if({_P} > 0.5 AND label = 0) AS fp,
             count_if({_P} <= 0.5 AND label = 0) AS tn, count_if({_P} <= 0.5 AND label = 1) AS fn
      FROM clx, models WHERE split = 'val' GROUP BY reg, ratio)
SELECT reg AS "regParam", ratio AS "elasticNetParam", tp, fp, tn, fn, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
       (tp + tn) / (tp + fp + tn + fn) AS accuracy FROM c""")
def q_grid_search(spark, sf):
    """12 configurations: as many scans as one, and one to score them all."""
    data = _class_data(spark, sf)
    fits = ST.fit_logistic(data.filter(F.col("split") == "train"), GRID)
    named = spark.createDataFrame([(i, r, e) for i, (r, e) in enumerate(GRID)], "config int, regParam double, elasticNetParam double")
    return named.join(ST.confusion_of_all(data.filter(F.col("split") == "val"), fits, 0.5), "config") \
        .select("regParam", "elasticNetParam", "tp", "fp", "tn", "fn", "recall", "accuracy")


COHORT_SQL = f"""{MP.LAB_SQL},
hs AS MATERIALIZED (SELECT patient_id, label, CASE WHEN pos <= ceil(n * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY {MP._u('patient_id')}, patient_id) AS pos, count(*) OVER () AS n FROM lab) s),
bad AS (SELECT DISTINCT feature FROM cells JOIN hs USING (patient_id) WHERE split = 'train' AND beta IS NULL),
coh AS (SELECT cohort, patient_id, list(beta ORDER BY feature) AS x FROM cohorts WHERE feature NOT IN (SELECT feature FROM bad) GROUP BY cohort, patient_id)"""
TRAIN_ROWS = """SELECT patient_id, list(beta ORDER BY feature) AS x, any_value(label) AS label FROM cells JOIN hs USING (patient_id)
  WHERE split = 'train' AND feature NOT IN (SELECT feature FROM bad) GROUP BY patient_id"""


@register("cohort_eval", f"""WITH RECURSIVE {COHORT_SQL}, {_logistic_sql(CLASSIFIER, TRAIN_ROWS)},
sc AS (SELECT cohort, patient_id, {_P} > 0.6::DOUBLE AS pos FROM coh, models),
k AS (SELECT cohort, count(*) AS n_scored, count_if(pos) AS n_positive, count_if(split = 'test' AND pos AND label = 1) AS tp, count_if(split = 'test' AND pos AND label = 0) AS fp,
             count_if(split = 'test' AND NOT pos AND label = 0) AS tn, count_if(split = 'test' AND NOT pos AND label = 1) AS fn
      FROM sc LEFT JOIN hs USING (patient_id) GROUP BY cohort)
SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
       coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0.0) AS accuracy FROM k""")
def q_cohort_eval(spark, sf):
    """A model fitted on the training patients of the main cohort scores every row of the external
    cohorts a/b/c; confusion counts are of the labelled patients that the fit has not seen."""
    lab = cut_lineage(SM.split3(MP._lab(spark, sf), "patient_id", 0.3, None, MP.SEED))
    seen = lab.filter(F.col("split") == "train")
    clean = MD.M.drop_null(X.cells(spark, sf).join(seen.select("patient_id"), "patient_id", "left_semi"), "features")
    order = cut_lineage(MD.M.feature_order(clean))
    train = cut_lineage(MD.M.pack(clean, order).join(seen, "patient_id"))
    rows = MD.M.pack(X.cohorts(spark, sf), order, ("cohort", "patient_id"))
    scored = ST.probability(rows, ST.fit_logistic(train, CLASSIFIER)[0]).join(lab, "patient_id", "left")
    pos, held = F.col("p") > 0.6, F.col("split") == "test"
    count = lambda c, name: F.count_if(c).alias(name)
    k = scored.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_scored"), count(pos, "n_positive"), *[
        count(held & said & (F.col("label") == y), name) for said, y, name in ((pos, 1, "tp"), (pos, 0, "fp"), (~pos, 0, "tn"), (~pos, 1, "fn"))])
    share = lambda a, b, name: F.coalesce(F.try_divide(a, b), F.lit(0.0)).alias(name)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return k.select("*", share(tp, tp + fp, "precision"), share(tp, tp + fn, "recall"), share(tp + tn, tp + fp + tn + fn, "accuracy"))


@register("score_batch", f"""WITH RECURSIVE {MP.LAB_SQL}, {MP.SPLIT_SQL}, {CLASS_ROWS_SQL}, {_logistic_sql(CLASSIFIER)}
SELECT patient_id AS name, round({_P}, 6) AS p, CAST({_P} > 0.5::DOUBLE AS INTEGER) AS prediction FROM clx, models WHERE split <> 'train'""")
def q_score_batch(spark, sf):
    """Batch scoring of items the model was not fitted on to (name, probability, class)."""
    return _classified(spark, sf).select(F.col("patient_id").alias("name"), F.round("p", 6).alias("p"), F.bround("p", 0).cast("int").alias("prediction"))


def _sentiment(spark, sf):
    docs = X.labelled_docs(spark, sf).select("text", F.col("quality").cast("double").alias("label"))
    model = MD.sentiment_pipeline("text", "label").fit(docs)
    return model


@register("sentiment")
def q_sentiment(spark, sf):
    model = _sentiment(spark, sf)
    arts = TO.nonempty(X.articles(spark, sf)).select("doc_id", F.col("content").alias("text"))
    p = MD.positive_probability(model.transform(arts))
    return p.select("doc_id", F.when(F.col("p") > 0.5, F.lit("POSITIVE")).otherwise(F.lit("NEGATIVE")).alias("label"),
                    F.greatest("p", F.lit(1.0) - F.col("p")).alias("score"))


@register("news_report")
def q_news_report(spark, sf):
    """Title + summary + sentiment label and score, joined by article id."""
    arts = TO.nonempty(X.articles(spark, sf))
    summ = TO.summarize(arts, "doc_id", "content")
    model = _sentiment(spark, sf)
    scored = MD.positive_probability(model.transform(summ.select("doc_id", F.col("summary").alias("text"))))
    sent = scored.select("doc_id", F.when(F.col("p") > 0.5, F.lit("POSITIVE")).otherwise(F.lit("NEGATIVE")).alias("sentiment"),
                         F.greatest("p", F.lit(1.0) - F.col("p")).alias("sentiment_score"))
    titled = arts.filter(F.col("title").isNotNull()).select("doc_id", "title")
    return titled.join(summ, "doc_id").join(sent, "doc_id").select("doc_id", "title", "summary", "sentiment",
                                                                   "sentiment_score")


@register("covariate_model")
def q_covariate_model(spark, sf):
    """The covariate-classification flow end to end: label, select
    features by mutual information, balance the minority class with perturbed
    copies, split by patient (copies never leak across splits), scale on the
    training split, fit, and report confusion counts at the 0.60 threshold."""
    lab = cut_lineage(MP._lab(spark, sf))                       # one row per patient
    cells = MD.M.drop_null(X.cells(spark, sf), "features")      # one feature list for selection, training and scoring
    mi = S.mutual_info_binned(cells, lab.withColumnRenamed("label", "y"), "patient_id", "feature", "beta", "y")
    chosen = cut_lineage(S.select_features(mi, MP.FACTORS[0]).select("feature"))     # small: computed once
    lc = MD.M.project(cells, chosen, strict=False).join(lab, "patient_id")
    k = lab.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("c1"))
    r = k.select(F.when(F.col("c1") > F.col("n") - F.col("c1"), 0).otherwise(1).alias("minority"),
                 MD_B.minority_replicas(F.col("n"), F.least(F.col("c1"), F.col("n") - F.col("c1"))).alias("u")).first()
    mc = lc.filter(F.col("label") == r["minority"])
    balanced = MD_B.upsample(lc, MD_B.perturb(mc, lab.filter(F.col("label") == r["minority"]), MP.PCT, MP.PERTURB_SEED), r["u"])
    split = SM.split3(lab.select("patient_id"), "patient_id", 0.2, 0.2, MP.SEED)
    cells_s = balanced.join(split, "patient_id")
    fit = scaler_fit(cells_s.filter(F.col("split") == "train"))
    z = scaler_apply(cells_s, fit).drop("beta").withColumnRenamed("z", "beta")
    order = MD.M.feature_order(chosen.join(cells.select("feature").distinct(), "feature"))
    vec = MD.feature_vectors(z.select("patient_id", "replica", "split", "feature", "beta"), order,
                             keys=("patient_id", "replica", "split")).join(lab, "patient_id")
    vec = cut_lineage(vec)        # one packed row per (patient, replica): fit and scoring reuse it
    model = MD.classifier().fit(vec.filter(F.col("split") == "train"))
    scored = MD.positive_probability(model.transform(vec))
    return S.confusion(scored, "label", "p", 0.6, ["split"])


@register("tscore_model", f"""WITH RECURSIVE {ROWS_SQL}, {HOLD_OUT_SQL},
{_solve_sql(CV_SETS + " UNION ALL " + TRAIN_SET, [0.3])}, {CV_SQL},
val AS (SELECT y, b0 + list_dot_product(x, b) AS yhat FROM rowsx JOIN hold USING (patient_id) JOIN fits ON s = -1 WHERE split = 'test')
SELECT count(*) AS n, round(avg(abs(y - yhat)), 6) AS mae, round(avg((y - yhat) * (y - yhat)), 6) AS mse, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse,
       round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(yhat - y), 6) AS mean_error,
       round(regr_slope(yhat, y), 6) AS slope, round(regr_intercept(yhat, y), 6) AS intercept, (SELECT round(avg(neg_mae), 6) FROM cv) AS cv_neg_mae FROM val""")
def q_tscore_model(spark, sf):
    """The regression flow end to end: target join, drop missing targets,
    4-fold contiguous CV of the elastic net (mean -MAE), hold-out fit on a 90/10
    split, error metrics and the least-squares line of prediction on truth."""
    data = cut_lineage(_packed(spark, sf))                      # one packed row per patient: three scans share it
    cv_mean = _cv_neg_mae(data).agg(F.avg("neg_mae")).first()[0]
    split = SM.split3(data, "patient_id", 0.1, None, MP.SEED)
    fit = MO.path(MO.fold_moments(split.filter(F.col("split") == "train"), F.lit(0)).without(), [0.3])[0.3]
    val = cut_lineage(MO.predict(split.filter(F.col("split") == "test"), fit).select("y", "yhat"))
    line = S.fit_line(val, "y", "yhat").first()                 # two numbers
    out = S.regression_metrics(val, "y", "yhat").select(
        "*", F.lit(line["slope"]).alias("slope"), F.lit(line["intercept"]).alias("intercept"), F.lit(cv_mean).alias("cv_neg_mae"))
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])
