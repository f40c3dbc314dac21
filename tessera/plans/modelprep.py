"""Query keys for sampling, splits, balancing, scaling and feature selection
(SURVEY 2.6 L2/L4-L8, 2.5 W11, 2.8 H1-H4, 2.7 U1/U2, 2.4 G6-G8/G19, 2.9 M1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.random import uniform
from tessera.operators import balance as B
from tessera.operators import labels as L
from tessera.operators import sampling as SM
from tessera.operators import stats as S
from tessera.operators.ranking import global_rank
from tessera.plans import fixtures as X
from tessera.plans.fixture_sql import sql_uniform
from tessera.plans.registry import register
from tessera.session import cut_lineage

SEED = 42
PERTURB_SEED = 7
PCT = 5.0
FACTORS = (1.5, 2.0, 2.5, 3.0)

# labelled cells of the patients shared by metadata and matrix
LAB_SQL = """lab AS (SELECT patient_id, coalesce(CAST(contains(lower(status), 'lung') AS INTEGER), 0) AS label FROM meta
             WHERE patient_id IN (SELECT patient_id FROM cells)),
lab_cells AS (SELECT c.patient_id, c.feature, c.beta, l.label FROM cells c JOIN lab l USING (patient_id))"""


def _lab(spark, sf):
    lab = X.meta(spark, sf).select("patient_id", L.label_contains("status", "lung", case=False).alias("label"))
    return lab.join(X.cells(spark, sf).select("patient_id"), "patient_id", "left_semi")


def _lab_cells(spark, sf):
    return L.attach(X.cells(spark, sf), _lab(spark, sf), "inner")


def _u(key, seed=SEED):
    return sql_uniform(str(seed), key)


@register("shuffle", f"""
WITH {LAB_SQL}
SELECT patient_id, label, row_number() OVER (ORDER BY {_u('patient_id')}, patient_id) AS pos FROM lab""")
def q_shuffle(spark, sf):
    return SM.shuffle(_lab(spark, sf), "patient_id", SEED)


@register("sample_per_class", f"""
SELECT item_id, class, path FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {_u('item_id')}, item_id) AS r
FROM class_items) s WHERE r <= 500""")
def q_sample_per_class(spark, sf):
    items = X.class_items(spark, sf)
    return SM.sample_per_class(items, "class", "item_id", k=500, seed=SEED)


@register("two_class_set", f"""
WITH m AS (SELECT min(class) AS neg, max(class) AS pos FROM class_items),
s AS (SELECT item_id, class, path, CAST(class = m.pos AS INTEGER) AS label,
             row_number() OVER (PARTITION BY class ORDER BY {_u('item_id')}, item_id) AS r FROM class_items, m WHERE class IN (m.neg, m.pos)),
p AS (SELECT *, row_number() OVER (ORDER BY {_u('item_id', SEED + 1)}, item_id) AS p, count(*) OVER () AS n FROM s WHERE r <= 500)
SELECT item_id, class, path, label, count(*) OVER (PARTITION BY label) / n AS share,
       CASE WHEN p <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'eval' END AS split FROM p""")
def q_two_class_set(spark, sf):
    items = X.class_items(spark, sf)
    names = items.agg(F.min("class"), F.max("class")).first()       # two names
    return SM.two_class_set(items, "class", "item_id", names[1], names[0], 500, 0.8, SEED)


@register("sample_half", f"""
WITH {LAB_SQL}
SELECT patient_id, label FROM (SELECT *, row_number() OVER (ORDER BY {_u('patient_id')}, patient_id) AS pos,
  count(*) OVER () AS n FROM lab) s WHERE pos <= floor(n / 2)""")
def q_sample_half(spark, sf):
    return SM.sample_half(_lab(spark, sf), "patient_id", SEED)


SPLIT_SQL = f"""split AS (SELECT patient_id, label, CASE WHEN pos <= ceil(n * 0.2::DOUBLE) THEN 'test'
  WHEN pos <= ceil(n * 0.2::DOUBLE) + ceil((n - ceil(n * 0.2::DOUBLE)) * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY {_u('patient_id')}, patient_id) AS pos, count(*) OVER () AS n FROM lab) s)"""


def _split(spark, sf):
    return SM.split3(_lab(spark, sf), "patient_id", 0.2, 0.2, SEED)


@register("split3", f"WITH {LAB_SQL}, {SPLIT_SQL} SELECT * FROM split")
def q_split3(spark, sf):
    return _split(spark, sf)


@register("split_prefix", """
SELECT doc_id, title, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(count(*) OVER () * 0.8::DOUBLE)
       THEN 'train' ELSE 'eval' END AS split FROM articles WHERE length(content) > 0""")
def q_split_prefix(spark, sf):
    a = X.articles(spark, sf).filter(F.length("content") > 0).select("doc_id", "title")
    return SM.split_prefix(a, ["doc_id"], 0.8)


@register("kfold_ids", """
WITH t AS (SELECT id, y, row_number() OVER (ORDER BY id) - 1 AS p, count(*) OVER () AS n FROM preds),
f AS (SELECT *, n // 4 AS base, n % 4 AS extra FROM t)
SELECT id, y, CAST(CASE WHEN p < extra * (base + 1) THEN p // (base + 1)
                   ELSE extra + (p - extra * (base + 1)) // base END AS INTEGER) AS fold FROM f""")
def q_kfold_ids(spark, sf):
    return SM.kfold_ids(X.preds(spark, sf).select("id", "y"), ["id"], 4)


def _bounds_sql(n="n"):
    inner = ", ".join(f"CAST(round_even({j / 10!r}::DOUBLE * {n}, 0) AS BIGINT)" for j in range(1, 10))
    return f"[0, {inner}, {n} - 1]"


SLICES_SQL = f"""pp AS (SELECT patient_id, row_number() OVER (ORDER BY patient_id) - 1 AS i, count(*) OVER () AS n
                 FROM (SELECT DISTINCT patient_id FROM {{src}}) d),
sl AS (SELECT patient_id, i, unnest(list_filter(range(0, 10), lambda s: {_bounds_sql()}[s + 1] <= i
                                           AND i <= {_bounds_sql()}[s + 2])) AS slice FROM pp)"""


@register("decile_slices", f"WITH {LAB_SQL}, {SLICES_SQL.format(src='lab')} SELECT patient_id, i AS pos, CAST(slice AS INTEGER) AS slice FROM sl")
def q_decile_slices(spark, sf):
    sl = B.slices(_lab(spark, sf), "patient_id")
    return sl.select("patient_id", F.col("_i").alias("pos"), F.explode("_slices").alias("slice"))


def _factor_sql(src_cells: str, slices: str) -> str:
    lo, hi = (100 - PCT) / 100, (100 + PCT) / 100
    u = sql_uniform(str(PERTURB_SEED), "c.feature", "s.slice")
    return f"""(SELECT c.patient_id, c.feature, product({lo!r}::DOUBLE + {hi - lo!r}::DOUBLE * {u}) AS fac
               FROM {src_cells} c JOIN {slices} s USING (patient_id) GROUP BY c.patient_id, c.feature)"""


PERTURB_SQL = f"""{SLICES_SQL.format(src='lab')},
pert AS (SELECT c.patient_id, c.feature, c.beta * f.fac AS beta, c.label FROM lab_cells c
         JOIN {_factor_sql('lab_cells', 'sl')} f USING (patient_id, feature))"""


@register("perturb", f"WITH {LAB_SQL}, {PERTURB_SQL} SELECT * FROM pert")
def q_perturb(spark, sf):
    return B.perturb(_lab_cells(spark, sf), _lab(spark, sf), PCT, PERTURB_SEED)


@register("upsample_union", f"""
WITH {LAB_SQL}
SELECT *, 0 AS replica FROM lab_cells UNION ALL SELECT *, unnest(range(1, 4)) AS replica FROM lab_cells""")
def q_upsample_union(spark, sf):
    lc = _lab_cells(spark, sf)
    return B.upsample(lc, lc, 3)


@register("upsample_overall", f"""
WITH {LAB_SQL}, {PERTURB_SQL}
SELECT *, 0 AS replica FROM lab_cells UNION ALL SELECT *, unnest(range(1, 3)) AS replica FROM pert""")
def q_upsample_overall(spark, sf):
    lc = _lab_cells(spark, sf)
    return B.upsample(lc, B.perturb(lc, _lab(spark, sf), PCT, PERTURB_SEED), 2)


MINORITY_SQL = f"""
WITH RECURSIVE {LAB_SQL},
mk AS (SELECT n, CASE WHEN c1 > n - c1 THEN 0 ELSE 1 END AS minority, CASE WHEN c1 > n - c1 THEN n - c1 ELSE c1 END AS d
       FROM (SELECT count(*) AS n, count_if(label = 1) AS c1 FROM lab) k),
loop(u, share, runs, done) AS (
  SELECT 2, CAST(d AS DOUBLE) / n, 0, false FROM mk
  UNION ALL
  SELECT CASE WHEN runs + 1 > 50 THEN 1 ELSE u2 END, 100.0::DOUBLE * u2 * d / (u2 * d + n - 1), runs + 1, runs + 1 > 50
  FROM (SELECT l.*, CASE WHEN 55.0::DOUBLE - share > 0 THEN u + 1 ELSE u - 1 END AS u2, mk.d, mk.n FROM loop l, mk
        WHERE NOT done AND NOT (share <= 54 AND share >= 46) AND u >= 1) x),
rep AS (SELECT arg_max(u, runs) AS u FROM loop),
mc AS (SELECT * FROM lab_cells WHERE label = (SELECT minority FROM mk)),
{SLICES_SQL.format(src='mc')},
pert AS (SELECT c.patient_id, c.feature, c.beta * f.fac AS beta, c.label FROM mc c
         JOIN {_factor_sql('mc', 'sl')} f USING (patient_id, feature))"""


@register("balance_minority", MINORITY_SQL + """
SELECT *, 0 AS replica FROM lab_cells UNION ALL
SELECT *, unnest(range(1, (SELECT u FROM rep) + 1)) AS replica FROM pert""")
def q_balance_minority(spark, sf):
    # the label dimension (one row per patient) is materialised once, so the class
    # counts below do not re-scan the cells table
    lab = cut_lineage(_lab(spark, sf))
    lc = L.attach(X.cells(spark, sf), lab, "inner")
    k = lab.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("c1"))
    k = k.select("n", F.when(F.col("c1") > F.col("n") - F.col("c1"), 0).otherwise(1).alias("minority"),
                 F.least(F.col("c1"), F.col("n") - F.col("c1")).alias("d"))
    r = k.select("minority", B.minority_replicas(F.col("n"), F.col("d")).alias("u")).first()   # two integers
    mc = lc.filter(F.col("label") == r["minority"])
    return B.upsample(lc, B.perturb(mc, lab.filter(F.col("label") == r["minority"]), PCT, PERTURB_SEED), r["u"])


WHOLE_SQL = f"""
WITH RECURSIVE {LAB_SQL},
k AS (SELECT count(*) AS n, count_if(label = 1) AS c1 FROM lab),
kk AS (SELECT n, c1, 100.0::DOUBLE * c1 / (n - 1) AS share0, 100.0::DOUBLE * c1 / (n - 1) > 30 AS half FROM k),
kd AS (SELECT *, CASE WHEN half THEN n // 2 ELSE n END AS d, CASE WHEN share0 > 20 THEN 25.0 ELSE 15.0 END AS bound FROM kk),
loop(u, share, runs, done) AS (
  SELECT CAST(10 AS BIGINT), share0, 0, false FROM kd
  UNION ALL
  SELECT CASE WHEN u < 1 THEN 1 ELSE u2 END,
         CASE WHEN u < 1 THEN share ELSE 100.0::DOUBLE * u2 * d / (u2 * d + n - 1) END,
         CASE WHEN u < 1 THEN runs ELSE runs + 1 END,
         CASE WHEN u < 1 THEN true ELSE runs + 1 > 20 END
  FROM (SELECT l.*, kd.d, kd.n, CASE WHEN 50.0 - share > 0 AND 50.0 - share < bound THEN u + 1
                                     WHEN 50.0 - share < 0 AND 50.0 - share > -bound THEN u - 1
                                     ELSE u + CAST(round_even((50.0 - share) / 5, 0) AS BIGINT) END AS u2
        FROM loop l, kd WHERE NOT done) x),
rep AS (SELECT arg_max(u, runs + CASE WHEN done THEN 0.5 ELSE 0 END) AS u FROM loop),
{PERTURB_SQL},
half_ids AS (SELECT patient_id FROM (SELECT patient_id, row_number() OVER (ORDER BY {_u('patient_id')}, patient_id) AS pos,
             count(*) OVER () AS n FROM lab) s WHERE pos <= floor(n / 2) OR NOT (SELECT half FROM kd)),
dup AS (SELECT * FROM pert WHERE patient_id IN (SELECT patient_id FROM half_ids))"""


@register("balance_whole", WHOLE_SQL + """
SELECT *, 0 AS replica FROM lab_cells UNION ALL
SELECT *, unnest(range(1, (SELECT u FROM rep) + 1)) AS replica FROM dup""")
def q_balance_whole(spark, sf):
    lab = cut_lineage(_lab(spark, sf))          # one row per patient, materialised once
    lc = L.attach(X.cells(spark, sf), lab, "inner")
    k = lab.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("c1"))
    k = k.withColumn("half", F.lit(100.0) * F.col("c1") / (F.col("n") - 1) > 30)
    r = k.select("half", B.whole_replicas(F.col("n"), F.col("c1"), F.col("half")).alias("u")).first()
    pert = B.perturb(lc, lab, PCT, PERTURB_SEED)
    if r["half"]:
        keep = SM.sample_half(lab.select("patient_id"), "patient_id", SEED)
        pert = pert.join(keep, "patient_id", "left_semi")
    return B.upsample(lc, pert, r["u"])


SCALER_SQL = f"""{SPLIT_SQL},
fit AS (SELECT feature, avg(c.beta) AS mean, stddev_pop(c.beta) AS std FROM lab_cells c JOIN split s USING (patient_id)
        WHERE s.split = 'train' GROUP BY feature)"""


@register("scaler_fit", f"WITH {LAB_SQL}, {SCALER_SQL} SELECT feature, round(mean, 9) AS mean, round(std, 9) AS std FROM fit")
def q_scaler_fit(spark, sf):
    from tessera.operators import scaling as SC
    lc = _lab_cells(spark, sf).join(_split(spark, sf).select("patient_id", "split"), "patient_id")
    fit = SC.scaler_fit(lc.filter(F.col("split") == "train"))
    return fit.select("feature", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@register("scale_apply", f"""WITH {LAB_SQL}, {SCALER_SQL}
SELECT c.patient_id, c.feature, s.split, round((c.beta - f.mean) / CASE WHEN f.std = 0 THEN 1.0 ELSE f.std END, 9) AS z
FROM lab_cells c JOIN split s USING (patient_id) JOIN fit f USING (feature)""")
def q_scale_apply(spark, sf):
    from tessera.operators import scaling as SC
    lc = _lab_cells(spark, sf).join(_split(spark, sf).select("patient_id", "split"), "patient_id")
    fit = SC.scaler_fit(lc.filter(F.col("split") == "train"))
    z = SC.scaler_apply(lc, fit)
    return z.select("patient_id", "feature", "split", F.round("z", 9).alias("z"))


def _mi_sql(labels_sql: str, y_binned: bool) -> str:
    yb = ("CAST(CASE WHEN yhi = ylo THEN 0 ELSE least(floor((y - ylo) / (yhi - ylo) * 10), 9) END AS VARCHAR)"
          if y_binned else "CAST(y AS VARCHAR)")
    return f"""
yl AS ({labels_sql}),
j AS (SELECT c.feature, c.beta, yl.y FROM cells c JOIN yl USING (patient_id) WHERE c.beta IS NOT NULL AND yl.y IS NOT NULL),
r AS (SELECT feature, min(beta) AS lo, max(beta) AS hi FROM j GROUP BY feature),
yr AS (SELECT min(y) AS ylo, max(y) AS yhi FROM yl),
b AS (SELECT j.feature, CASE WHEN hi = lo THEN 0 ELSE least(floor((beta - lo) / (hi - lo) * 10), 9) END AS xb,
             {yb} AS yb FROM j JOIN r USING (feature), yr),
c AS (SELECT feature, xb, yb, count(*) AS nxy FROM b GROUP BY ALL),
t AS (SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n, sum(nxy) OVER (PARTITION BY feature, xb) AS nx,
             sum(nxy) OVER (PARTITION BY feature, yb) AS ny FROM c),
mi AS (SELECT feature, sum(nxy / n * ln(nxy * n / (nx * ny))) AS mi FROM t GROUP BY feature)"""


CLASS_LABELS_SQL = ("SELECT patient_id, coalesce(CAST(contains(lower(status), 'lung') AS INTEGER), 0) AS y FROM meta")


@register("mi_class", f"WITH {_mi_sql(CLASS_LABELS_SQL, False)} SELECT feature, round(mi, 9) AS mi FROM mi")
def q_mi_class(spark, sf):
    y = X.meta(spark, sf).select("patient_id", L.label_contains("status", "lung", case=False).alias("y"))
    mi = S.mutual_info_binned(X.cells(spark, sf), y, "patient_id", "feature", "beta", "y", bins=10)
    return mi.select("feature", F.round("mi", 9).alias("mi"))


@register("mi_reg", f"WITH {_mi_sql('SELECT patient_id, y FROM target', True)} SELECT feature, round(mi, 9) AS mi FROM mi")
def q_mi_reg(spark, sf):
    y = X.target(spark, sf)
    mi = S.mutual_info_binned(X.cells(spark, sf), y, "patient_id", "feature", "beta", "y", bins=10, y_bins=10)
    return mi.select("feature", F.round("mi", 9).alias("mi"))


@register("select_features", f"""WITH {_mi_sql(CLASS_LABELS_SQL, False)}
SELECT CAST(factor AS DOUBLE) AS factor, feature, round(mi, 9) AS mi FROM mi, (VALUES (1.5), (2.0), (2.5), (3.0)) f(factor)
WHERE mi > CAST(factor AS DOUBLE) * (SELECT avg(mi) FROM mi)""")
def q_select_features(spark, sf):
    y = X.meta(spark, sf).select("patient_id", L.label_contains("status", "lung", case=False).alias("y"))
    mi = S.mutual_info_binned(X.cells(spark, sf), y, "patient_id", "feature", "beta", "y", bins=10)
    return S.select_features(mi, FACTORS).select("factor", "feature", F.round("mi", 9).alias("mi"))


def _psi_sql(n: str) -> str:
    small = " ".join(f"WHEN {n} = {k} THEN {v!r}" for k, v in S._PSI_SMALL.items())
    x = f"CAST({n} AS DOUBLE)"
    asym = (f"ln({x}) - 0.5 / {x} - {1.0 / 12!r} / ({x} * {x}) + {1.0 / 120!r} / pow({x}, 4) "
            f"- {1.0 / 252!r} / pow({x}, 6) + {1.0 / 240!r} / pow({x}, 8)")
    return f"(CASE {small} ELSE {asym} END)"


@register("mi_class_knn", f"""
WITH yl AS ({CLASS_LABELS_SQL}),
j AS (SELECT c.feature, c.patient_id, c.beta AS x, yl.y FROM cells c JOIN yl USING (patient_id)
      WHERE c.beta IS NOT NULL AND yl.y IS NOT NULL),
j2 AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS ny FROM j),
j3 AS (SELECT *, least(3, ny - 1) AS k, list(x) OVER (PARTITION BY feature, y ORDER BY x, patient_id
              ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS nb FROM j2 WHERE ny > 1),
j4 AS (SELECT *, list_sort(list_transform(nb, lambda v: abs(v - x)))[k + 1] AS d FROM j3),
pr AS (SELECT feature, x AS v, 1 AS t, NULL::VARCHAR AS pid, 1 AS is_data, NULL::VARCHAR AS side, NULL::INTEGER AS k,
              NULL::BIGINT AS ny FROM j4
       UNION ALL SELECT feature, x + d, CASE WHEN d > 0 THEN 0 ELSE 2 END, patient_id, 0, 'hi', k, ny FROM j4
       UNION ALL SELECT feature, x - d, CASE WHEN d > 0 THEN 2 ELSE 0 END, patient_id, 0, 'lo', k, ny FROM j4),
c AS (SELECT *, sum(is_data) OVER (PARTITION BY feature ORDER BY v, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             AS cnt FROM pr),
m AS (SELECT feature, pid, sum(CASE WHEN side = 'hi' THEN cnt ELSE -cnt END) AS m, max(k) AS k, max(ny) AS ny
      FROM c WHERE is_data = 0 GROUP BY feature, pid),
r AS (SELECT feature, {_psi_sql('count(*)')} + avg({_psi_sql('k')}) - avg({_psi_sql('ny')}) - avg({_psi_sql('m')}) AS mi
      FROM m GROUP BY feature)
SELECT feature, round(greatest(mi, 0.0), 9) AS mi FROM r""")
def q_mi_class_knn(spark, sf):
    y = X.meta(spark, sf).select("patient_id", L.label_contains("status", "lung", case=False).alias("y"))
    mi = S.mutual_info_knn(X.cells(spark, sf), y, "patient_id", "feature", "beta", "y", k=3)
    return mi.select("feature", F.round("mi", 9).alias("mi"))


@register("mi_reg_knn", f"""
WITH yl AS (SELECT patient_id, y FROM target WHERE y IS NOT NULL),
uy AS (SELECT stddev_pop(y) AS s FROM yl),
j AS (SELECT c.feature, c.patient_id AS pid, c.beta, yl.y FROM cells c JOIN yl USING (patient_id) WHERE c.beta IS NOT NULL),
ux AS (SELECT feature, stddev_pop(beta) AS s, count(*) AS n FROM j GROUP BY feature),
z AS MATERIALIZED (SELECT j.feature, pid, beta / CASE WHEN ux.s = 0 THEN 1.0 ELSE ux.s END AS x, y / uy.s AS y, n
                   FROM j JOIN ux USING (feature), uy),
d AS MATERIALIZED (SELECT a.feature, a.pid, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3)[least(3, max(a.n) - 1)] AS d
                   FROM z a JOIN z b ON a.feature = b.feature AND a.pid <> b.pid GROUP BY a.feature, a.pid),
m AS (SELECT a.feature, a.pid, max(a.n) AS n, count_if(CASE WHEN d > 0 THEN abs(a.x - b.x) < d ELSE a.x = b.x END) AS nx,
             count_if(CASE WHEN d > 0 THEN abs(a.y - b.y) < d ELSE a.y = b.y END) AS ny
      FROM z a JOIN d USING (feature, pid) JOIN z b ON a.feature = b.feature GROUP BY a.feature, a.pid),
r AS (SELECT feature, {_psi_sql('max(n)')} + {_psi_sql('least(3, max(n) - 1)')} - avg({_psi_sql('nx')} + {_psi_sql('ny')}) AS mi
      FROM m GROUP BY feature)
SELECT feature, round(greatest(mi, 0.0), 9) AS mi FROM r""")
def q_mi_reg_knn(spark, sf):
    from tessera.operators.neighbours import mutual_info_knn_target
    mi = mutual_info_knn_target(X.cells(spark, sf), X.target(spark, sf), "patient_id", "feature", "beta", "y", k=3)
    return mi.select("feature", F.round("mi", 9).alias("mi"))
