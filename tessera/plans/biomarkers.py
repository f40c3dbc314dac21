"""Query keys for the biomarker matrix, labels, cohorts and cohort statistics
(SURVEY 2.1 S4-S6, 2.2 P2-P7/P10-P14/P31/P35, 2.3 J1-J6, 2.4 G3-G5/G9/G10, 2.7 U3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import labels as L
from tessera.operators import matrix as M
from tessera.operators import stats as S
from tessera.operators.ranking import global_rank, row_count
from tessera.plans import fixtures as X
from tessera.sources import chunks as C
from tessera.sources import tiles as TL
from tessera.plans.registry import register

LONG_SQL = ("SELECT CAST(vec_id AS VARCHAR) AS patient_id, 'cg' || printf('%02d', pos) AS feature, "
            "CAST(v AS DOUBLE) AS beta FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS pos, "
            "unnest(embedding) AS v FROM embeddings) e")

LUNG_LABEL_SQL = ("SELECT patient_id, status, coalesce(CAST(contains(lower(status), 'lung') AS INTEGER), 0) AS label "
                  "FROM meta")


def _lung_labels(spark, sf):
    return X.meta(spark, sf).withColumn("label", L.label_contains("status", "LUNG", case=False))


@register("matrix_long", LONG_SQL)
def q_matrix_long(spark, sf):
    return M.unpack(X.table(spark, sf, "embeddings"), "vec_id", "embedding")


@register("chunk_union", LONG_SQL)
def q_chunk_union(spark, sf):
    return M.unpack_chunks(X.table(spark, sf, "embeddings"), "vec_id", "embedding", chunk=16)


PATIENTS_A_FILE, FEATURES_A_FILE = 500, 16


def _chunk_files(spark, sf):
    """The matrix as CSV files of 16 features and 500 patients: (path, content).  Of five files one has a
    field too many in its last line and one a byte that is no text."""
    chunk, block = F.floor(F.substring("feature", 3, 9).cast("int") / FEATURES_A_FILE), F.floor(F.col("patient_id").cast("bigint") / PATIENTS_A_FILE)
    cells = X.cells(spark, sf).select(chunk.alias("chunk"), block.alias("block"), "patient_id", F.struct("feature", "beta").alias("x"))
    lines = cells.groupBy("chunk", "block", "patient_id").agg(F.sort_array(F.collect_list("x")).alias("x")).select(
        "chunk", "block", F.concat(F.lit(","), F.array_join("x.feature", ",")).alias("header"),
        F.concat_ws(",", "patient_id", F.array_join("x.beta", ",", "")).alias("line"))
    files = lines.groupBy("chunk", "block").agg(F.min("header").alias("header"), F.sort_array(F.collect_list("line")).alias("lines"))
    kind = (F.col("chunk") + 3 * F.col("block")) % 5
    text = F.concat_ws("\n", "header", F.array_join("lines", "\n"))
    content = F.when(kind == 1, F.encode(F.concat(text, F.lit(",9")), "UTF-8")).when(kind == 2, F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("0AFF")))) \
        .otherwise(F.encode(text, "UTF-8"))
    return files.select(F.format_string("chunk_%d_%d.csv", "chunk", "block").alias("path"), content.alias("content"))


_FILES_SQL = f"""
WITH f AS (SELECT *, CAST(substr(feature, 3) AS INTEGER) // {FEATURES_A_FILE} AS chunk, CAST(patient_id AS BIGINT) // {PATIENTS_A_FILE} AS block FROM cells),
g AS (SELECT *, 'chunk_' || chunk || '_' || block || '.csv' AS path, (chunk + 3 * block) % 5 AS kind FROM f)"""


@register("chunk_cells", _FILES_SQL + " SELECT path, patient_id, feature, beta FROM g WHERE kind NOT IN (1, 2)")
def q_chunk_cells(spark, sf):
    return C.cells_of(C.parse_chunks(_chunk_files(spark, sf)))


@register("chunk_report", _FILES_SQL + """, r AS (SELECT path, kind, count(DISTINCT patient_id) AS n, count(DISTINCT feature) AS m FROM g GROUP BY ALL)
SELECT path, CASE kind WHEN 1 THEN 'row ' || n || ': ' || (m + 2) || ' fields, ' || (m + 1) || ' expected' WHEN 2 THEN 'not utf-8' END AS reason,
       CASE WHEN kind IN (1, 2) THEN 0 ELSE n END AS n_rows, CASE WHEN kind IN (1, 2) THEN 0 ELSE m END AS n_features, 0::BIGINT AS n_bad FROM r""")
def q_chunk_report(spark, sf):
    return C.report_of(C.parse_chunks(_chunk_files(spark, sf)))


WIDE_SLOTS, WIDE_DIM = 157, 64      # 10,048 columns


def _wide_tiles(spark, sf):
    """A matrix of 10,048 columns written as CSV row parts, read as tiles, and written as those.

    Row ``cg<block>`` holds 157 vectors side by side, column ``p<slot>_<component>``."""
    slot, block = F.pmod("vec_id", F.lit(WIDE_SLOTS)), F.floor(F.col("vec_id") / WIDE_SLOTS)
    vectors = X.table(spark, sf, "embeddings").select(block.alias("block"), F.struct(slot.cast("int").alias("slot"), F.transform(
        "embedding", lambda x: x.cast("double").cast("string")).alias("x")).alias("v"))
    lines = vectors.groupBy("block").agg(F.map_from_entries(F.collect_list("v")).alias("m"))
    blank = F.array_repeat(F.lit(""), WIDE_DIM)
    filled = F.flatten(F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda s: F.coalesce(F.try_element_at("m", s), blank)))
    lines = lines.select(F.concat(F.format_string("cg%05d,", "block"), F.array_join(filled, ",", "")).alias("value"))
    header = spark.range(1).select(F.concat(F.lit(","), F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(WIDE_SLOTS - 1)), lambda s: F.transform(
        F.sequence(F.lit(0), F.lit(WIDE_DIM - 1)), lambda j: F.concat(F.lit("p"), s, F.lit("_"), j)))), ",")).alias("value"))
    folder = X.shared_folder(spark, "tiles")
    header.unionByName(lines).write.text(folder + "/csv")
    TL.read_tiles(spark, folder + "/csv").write.parquet(folder + "/tiles")
    X.remove_folder(spark, folder + "/csv")
    return spark.read.parquet(folder + "/tiles")


_WIDE_SQL = f"""
WITH v AS (SELECT vec_id // {WIDE_SLOTS} AS block, vec_id % {WIDE_SLOTS} AS slot, embedding FROM embeddings),
x AS (SELECT block, slot, unnest(range(0, len(embedding))) AS j, unnest(embedding)::DOUBLE AS beta FROM v),
g AS (SELECT b.block, s.slot, j.j FROM (SELECT DISTINCT block FROM v) b, (SELECT unnest(range({WIDE_SLOTS})) AS slot) s, (SELECT unnest(range({WIDE_DIM})) AS j) j),
w AS (SELECT 'p' || g.slot || '_' || g.j AS patient_id, 'cg' || printf('%05d', g.block) AS feature, CASE WHEN isnan(x.beta) THEN NULL ELSE x.beta END AS beta
      FROM g LEFT JOIN x USING (block, slot, j))"""


@register("tile_cells", _WIDE_SQL + " SELECT * FROM w")
def q_tile_cells(spark, sf):
    return TL.cells(TL.transpose(_wide_tiles(spark, sf)))


@register("tile_shape", _WIDE_SQL + """
SELECT count(DISTINCT feature) AS n_rows, count(DISTINCT patient_id) AS n_cols,
       count(DISTINCT patient_id) < count(DISTINCT feature) AS transpose FROM w""")
def q_tile_shape(spark, sf):
    return TL.shape(_wide_tiles(spark, sf))


@register("tile_nulls", _WIDE_SQL + """
SELECT patient_id AS col_key, count(*) AS n_cells, CAST(count_if(beta IS NULL) AS BIGINT) AS n_null FROM w GROUP BY ALL""")
def q_tile_nulls(spark, sf):
    return TL.column_nulls(_wide_tiles(spark, sf))


@register("orientation", """
SELECT count(DISTINCT patient_id) AS n_rows, count(DISTINCT feature) AS n_cols,
       count(DISTINCT feature) < count(DISTINCT patient_id) AS transpose FROM cells""")
def q_orientation(spark, sf):
    return M.orientation(X.cells(spark, sf))


@register("project_features", "SELECT * FROM cells WHERE feature IN (SELECT feature FROM features)")
def q_project_features(spark, sf):
    # the fixture's list names features the matrix lacks, an error by default
    return M.project(X.cells(spark, sf), X.features(spark, sf), strict=False)


@register("feature_intersect", "SELECT feature FROM features INTERSECT SELECT feature FROM cells")
def q_feature_intersect(spark, sf):
    return M.feature_intersect(X.cells(spark, sf), X.features(spark, sf))


@register("feature_order", """
SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS pos FROM (SELECT DISTINCT feature FROM cells) f""")
def q_feature_order(spark, sf):
    return M.feature_order(X.cells(spark, sf))


@register("null_profile", """
SELECT feature, count(*) AS n_cells, CAST(count_if(beta IS NULL) AS BIGINT) AS n_null FROM cells GROUP BY feature""")
def q_null_profile(spark, sf):
    return M.null_profile(X.cells(spark, sf))


@register("drop_null_rows", """
SELECT * FROM cells c WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE b.beta IS NULL AND b.patient_id = c.patient_id)""")
def q_drop_null_rows(spark, sf):
    return M.drop_null(X.cells(spark, sf), "rows")


@register("drop_null_features", """
SELECT * FROM cells c WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE b.beta IS NULL AND b.feature = c.feature)""")
def q_drop_null_features(spark, sf):
    return M.drop_null(X.cells(spark, sf), "features")


@register("label_exact", """
SELECT patient_id, clinic,
  CASE WHEN lower(coalesce(clinic, 'nan')) = 'healthy' THEN 0 ELSE 1 END AS label_any,
  CASE WHEN lower(coalesce(clinic, 'nan')) = 'healthy' THEN 0 ELSE CAST(lower(coalesce(clinic, 'nan')) = 'lung' AS INTEGER) END AS label_lung,
  CASE WHEN lower(coalesce(clinic, 'nan')) = 'healthy' THEN 0 ELSE CAST(lower(coalesce(clinic, 'nan')) = 'heme' AS INTEGER) END AS label_heme
FROM clinic""")
def q_label_exact(spark, sf):
    c = X.clinic(spark, sf)
    return c.select("patient_id", "clinic", *[L.label_exact("clinic", t).alias(f"label_{t}") for t in ("any", "lung", "heme")])


@register("label_contains", """
SELECT patient_id, status, coalesce(CAST(contains(status, 'Lung') AS INTEGER), 0) AS label FROM meta""")
def q_label_contains(spark, sf):
    return X.meta(spark, sf).withColumn("label", L.label_contains("status", "Lung", case=True))


@register("label_icontains", LUNG_LABEL_SQL)
def q_label_icontains(spark, sf):
    return _lung_labels(spark, sf)


@register("shared_patients", f"""
SELECT c.patient_id, c.feature, c.beta, l.label FROM cells c JOIN ({LUNG_LABEL_SQL}) l USING (patient_id)""")
def q_shared_patients(spark, sf):
    lab = _lung_labels(spark, sf).select("patient_id", "label")
    return L.attach(X.cells(spark, sf), lab, "inner")


@register("missing_patients", """
SELECT patient_id FROM meta m WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.patient_id = m.patient_id)""")
def q_missing_patients(spark, sf):
    return L.missing(X.meta(spark, sf), X.cells(spark, sf))


@register("cohort_label", f"""
SELECT c.cohort, c.patient_id, c.feature, c.beta, l.label FROM cohorts c LEFT JOIN ({LUNG_LABEL_SQL}) l USING (patient_id)""")
def q_cohort_label(spark, sf):
    lab = _lung_labels(spark, sf).select("patient_id", "label")
    return L.attach(X.cohorts(spark, sf), lab, "left")


@register("class_split", f"""
SELECT l.patient_id, l.status, l.label FROM ({LUNG_LABEL_SQL}) l
WHERE l.label = 1 AND EXISTS (SELECT 1 FROM cells c WHERE c.patient_id = l.patient_id)""")
def q_class_split(spark, sf):
    lab = _lung_labels(spark, sf).join(X.cells(spark, sf).select("patient_id"), "patient_id", "left_semi")
    return lab.filter(F.col("label") == 1)


@register("class_distribution", f"""
WITH l AS (SELECT * FROM ({LUNG_LABEL_SQL}) x WHERE EXISTS (SELECT 1 FROM cells c WHERE c.patient_id = x.patient_id)),
k AS (SELECT label, count(*) AS n FROM l GROUP BY label)
SELECT label, n, round(n / (SELECT sum(n) FROM k), 9) AS frac, round(n / (SELECT sum(n) FROM k) * 100.0, 9) AS pct,
       round(ln(1.0 / (n / (SELECT sum(n) FROM k))), 9) AS log_inv FROM k""")
def q_class_distribution(spark, sf):
    lab = _lung_labels(spark, sf).join(X.cells(spark, sf).select("patient_id"), "patient_id", "left_semi")
    d = S.class_distribution(lab, "label")
    return d.select("label", "n", *[F.round(c, 9).alias(c) for c in ("frac", "pct", "log_inv")])


@register("class_distribution_n1", f"""
WITH l AS (SELECT * FROM ({LUNG_LABEL_SQL}) x WHERE EXISTS (SELECT 1 FROM cells c WHERE c.patient_id = x.patient_id)),
k AS (SELECT label, count(*) AS n FROM l GROUP BY label)
SELECT label, n, round(n / (SELECT sum(n) - 1 FROM k), 9) AS frac, round(n / (SELECT sum(n) - 1 FROM k) * 100.0, 9) AS pct,
       round(ln(1.0 / (n / (SELECT sum(n) - 1 FROM k))), 9) AS log_inv FROM k""")
def q_class_distribution_n1(spark, sf):
    """The variant whose denominator is one less than the rows."""
    lab = _lung_labels(spark, sf).join(X.cells(spark, sf).select("patient_id"), "patient_id", "left_semi")
    d = S.class_distribution(lab, "label", ddof=1)
    return d.select("label", "n", *[F.round(c, 9).alias(c) for c in ("frac", "pct", "log_inv")])


@register("distinct_values", """
SELECT status, n, row_number() OVER (ORDER BY status NULLS FIRST) AS pos, count(*) OVER () AS n_distinct
FROM (SELECT status, count(*) AS n FROM meta GROUP BY status) s""")
def q_distinct_values(spark, sf):
    """Sorted distinct values (``pos``), rows per value and how many values there are."""
    values = global_rank(X.meta(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n")), ["status"], "pos")
    return values.withColumn("n_distinct", F.lit(row_count(values)).cast("bigint"))


@register("id_normalize", """
SELECT r.raw_id, replace(r.raw_id, 'X', '') AS patient_id, m.status
FROM (SELECT DISTINCT 'X' || patient_id AS raw_id FROM cells) r JOIN meta m ON m.patient_id = replace(r.raw_id, 'X', '')""")
def q_id_normalize(spark, sf):
    raw = X.cells(spark, sf).select(F.concat(F.lit("X"), "patient_id").alias("raw_id")).distinct()
    norm = raw.withColumn("patient_id", L.normalize_id("raw_id"))
    return norm.join(X.meta(spark, sf), "patient_id").select("raw_id", "patient_id", "status")


@register("id_crosswalk", """
SELECT w.patient_id, t.kit_id, t.y FROM (SELECT 'K' || patient_id AS kit_id, y FROM target) t
JOIN (SELECT 'K' || patient_id AS kit_id, patient_id FROM meta) w USING (kit_id)""")
def q_id_crosswalk(spark, sf):
    scores = X.target(spark, sf).select(F.concat(F.lit("K"), "patient_id").alias("kit_id"), "y")
    walk = X.meta(spark, sf).select(F.concat(F.lit("K"), "patient_id").alias("kit_id"), "patient_id")
    return scores.join(walk, "kit_id").select("patient_id", "kit_id", "y")


@register("target_join", """
SELECT c.patient_id, c.feature, c.beta, t.y FROM cells c JOIN target t USING (patient_id) WHERE t.y IS NOT NULL""")
def q_target_join(spark, sf):
    t = X.target(spark, sf).na.drop(subset=["y"])
    return L.attach(X.cells(spark, sf), t, "inner")


@register("healthy_cohort", "SELECT id FROM disease WHERE n = 0")
def q_healthy_cohort(spark, sf):
    return X.disease(spark, sf).filter(F.col("n") == 0).select("id")


@register("cohort_semi", "SELECT * FROM population WHERE id IN (SELECT id FROM disease WHERE n = 0)")
def q_cohort_semi(spark, sf):
    healthy = X.disease(spark, sf).filter(F.col("n") == 0).select("id").distinct()
    return X.population(spark, sf).join(healthy, "id", "left_semi")


@register("key_intersect", "SELECT id FROM disease WHERE n = 0 INTERSECT SELECT id FROM population")
def q_key_intersect(spark, sf):
    healthy = X.disease(spark, sf).filter(F.col("n") == 0).select("id")
    return healthy.intersect(X.population(spark, sf).select("id"))


BUCKET_SQL = """
SELECT * FROM (SELECT id, pace, CASE WHEN pace < 2000 THEN 'healthy' WHEN pace > 2000 AND pace < 7000 THEN 'average'
               WHEN pace > 7000 THEN 'below' END AS bucket
               FROM population WHERE id IN (SELECT id FROM disease WHERE n = 0)) b WHERE bucket IS NOT NULL"""


def _buckets(spark, sf):
    healthy = X.disease(spark, sf).filter(F.col("n") == 0).select("id").distinct()
    pop = X.population(spark, sf).join(healthy, "id", "left_semi")
    return pop.withColumn("bucket", L.range_bucket("pace", 2000, 7000)).filter(F.col("bucket").isNotNull())


@register("range_bucket", BUCKET_SQL)
def q_range_bucket(spark, sf):
    return _buckets(spark, sf)


@register("histogram", f"""
WITH b AS ({BUCKET_SQL}), r AS (SELECT bucket, min(pace) AS lo_, max(pace) AS hi_ FROM b GROUP BY bucket),
h AS (SELECT bucket, CAST(CASE WHEN hi_ = lo_ THEN 6 ELSE least(floor((pace - lo_) / (hi_ - lo_) * 10) + 1, 10) END AS INTEGER) AS bin,
             lo_, hi_ FROM b JOIN r USING (bucket))
SELECT bucket, bin, lo_ + (hi_ - lo_) * (bin - 1) / 10.0 AS lo, lo_ + (hi_ - lo_) * bin / 10.0 AS hi, count(*) AS n
FROM h GROUP BY bucket, bin, lo_, hi_""")
def q_histogram(spark, sf):
    return S.histogram(_buckets(spark, sf), "pace", 10, ["bucket"])


@register("box_stats", f"""
WITH b AS ({BUCKET_SQL}),
q AS (SELECT bucket, quantile_cont(pace, 0.25) AS q25, quantile_cont(pace, 0.5) AS q50, quantile_cont(pace, 0.75) AS q75
      FROM b GROUP BY bucket),
j AS (SELECT b.*, q25, q50, q75, q75 - q25 AS iqr,
             pace >= q25 - 1.5 * (q75 - q25) AND pace <= q75 + 1.5 * (q75 - q25) AS inside FROM b JOIN q USING (bucket))
SELECT bucket, round(q25, 9) AS q25, round(q50, 9) AS q50, round(q75, 9) AS q75, round(iqr, 9) AS iqr,
       min(CASE WHEN inside THEN pace END) AS whisker_lo,
       max(CASE WHEN inside THEN pace END) AS whisker_hi, CAST(count_if(NOT inside) AS BIGINT) AS n_outliers, count(*) AS n
FROM j GROUP BY bucket, q25, q50, q75, iqr""")
def q_box_stats(spark, sf):
    b = S.box_stats(_buckets(spark, sf), "pace", ["bucket"])
    return b.select("bucket", *[F.round(c, 9).alias(c) for c in ("q25", "q50", "q75", "iqr")],
                    "whisker_lo", "whisker_hi", "n_outliers", "n")
