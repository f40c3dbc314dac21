"""Query keys for fundamentals extraction."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.operators import extract as E
from tessera.operators import returns as R
from tessera.plans import fixtures as X
from tessera.plans import prices as P
from tessera.plans.registry import register

METRICS = X.METRICS


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _extract_sql(src: str, tail: str, names: dict[str, str]) -> str:
    parts = []
    for m, label in names.items():
        pat = _sql_str(E.metric_regex(label, tail))
        parts.append(f"SELECT ticker, {_sql_str(m)} AS metric, nullif(regexp_extract(html, {pat}, 1), '') AS raw FROM {src}")
    return " UNION ALL ".join(parts)


def _clean_sql(raw: str) -> str:
    v = f"replace(string_split({raw}, '>')[-1], ',', '')"
    return (f"CASE WHEN contains({v}, 'T') THEN TRY_CAST(replace({v}, 'T', '') AS DOUBLE) * 1e12 "
            f"WHEN contains({v}, 'B') THEN TRY_CAST(replace({v}, 'B', '') AS DOUBLE) * 1e9 "
            f"WHEN contains({v}, 'M') THEN TRY_CAST(replace({v}, 'M', '') AS DOUBLE) * 1e6 "
            f"WHEN contains({v}, 'K') THEN TRY_CAST(replace({v}, 'K', '') AS DOUBLE) * 1e3 "
            f"ELSE TRY_CAST({v} AS DOUBLE) END")


def _failed_sql(raw: str) -> str:
    return f"({raw} IS NULL OR (regexp_matches(string_split({raw}, '>')[-1], '[TBMK]') AND {_clean_sql(raw)} IS NULL))"


SORRY = _sql_str(E.NO_DATA_MARKER)
PRIM_SQL = _extract_sql(f"(SELECT * FROM html_metrics WHERE NOT contains(html, {SORRY}))", E.PRIMARY_TAIL,
                        {m: m for m in METRICS})
WITH_BACKUP = {m: (E.BACKUP_ALIAS.get(m, m) or m) for m in METRICS if E.BACKUP_ALIAS.get(m, m) is not None}
BAD_SQL = " OR ".join(f"contains(html, {_sql_str(m)})" for m in E.BAD_BACKUP_MARKERS)
GOOD_BACK_SQL = _extract_sql(f"(SELECT * FROM html_backup WHERE NOT ({BAD_SQL}))", E.BACKUP_TAIL, WITH_BACKUP)
BACK_SQL = _extract_sql("html_backup", E.BACKUP_TAIL, WITH_BACKUP)


@register("metric_extract", PRIM_SQL)
def q_metric_extract(spark, sf):
    pages = X.html_metrics(spark, sf).filter(~F.col("html").contains(E.NO_DATA_MARKER))
    return E.extract_metrics(pages, METRICS)


@register("metric_clean", f"SELECT ticker, metric, raw, {_clean_sql('raw')} AS value FROM ({PRIM_SQL}) p")
def q_metric_clean(spark, sf):
    pages = X.html_metrics(spark, sf).filter(~F.col("html").contains(E.NO_DATA_MARKER))
    return E.extract_metrics(pages, METRICS).withColumn("value", E.clean_number("raw"))


@register("metric_backup", f"SELECT ticker, metric, raw, {_clean_sql('raw')} AS value FROM ({BACK_SQL}) b")
def q_metric_backup(spark, sf):
    names = WITH_BACKUP
    return (E.extract_metrics(X.html_backup(spark, sf), list(names), E.BACKUP_TAIL, names=names)
            .withColumn("value", E.clean_number("raw")))


FALLBACK_SQL = f"""
WITH p AS (SELECT ticker, metric, raw AS primary_raw, {_clean_sql('raw')} AS primary_v FROM ({PRIM_SQL}) a),
b AS (SELECT ticker, metric, raw AS backup_raw, {_clean_sql('raw')} AS backup_v FROM ({BACK_SQL}) c)
SELECT p.ticker, p.metric, CASE WHEN {_failed_sql('primary_raw')} AND backup_raw IS NOT NULL THEN backup_v ELSE primary_v END AS value,
       CASE WHEN NOT {_failed_sql('primary_raw')} THEN 'primary' WHEN backup_raw IS NOT NULL THEN 'backup' END AS source
FROM p LEFT JOIN b USING (ticker, metric)"""


@register("metric_fallback", FALLBACK_SQL)
def q_metric_fallback(spark, sf):
    return E.fallback(X.html_metrics(spark, sf), X.html_backup(spark, sf), METRICS)


@register("page_status", f"""
SELECT p.ticker, CASE WHEN contains(p.html, {SORRY}) THEN 'no_data' ELSE 'ok' END AS primary_status,
       coalesce(CASE WHEN b.ticker IS NULL THEN NULL
                     WHEN {' OR '.join(f"contains(b.html, {_sql_str(m)})" for m in E.BAD_BACKUP_MARKERS)} THEN 'bad'
                     ELSE 'ok' END, 'missing') AS backup_status
FROM html_metrics p LEFT JOIN html_backup b USING (ticker)""")
def q_page_status(spark, sf):
    return E.page_status(X.html_metrics(spark, sf), X.html_backup(spark, sf))


SECTOR_SQL = f"""
SELECT ticker, CASE WHEN s IS NULL THEN NULL WHEN list_position({[*E.SECTORS]}, s) > 0
       THEN CAST(list_position({[*E.SECTORS]}, s) - 1 AS INTEGER) ELSE 11 END AS sector
FROM (SELECT ticker, nullif(regexp_extract(html, {_sql_str(E.SECTOR_PATTERN)}, 1), '') AS s FROM sector_html) x"""


@register("sector_encode", SECTOR_SQL)
def q_sector_encode(spark, sf):
    return X.sector_html(spark, sf).select("ticker", E.sector_code("html").alias("sector"))


@register("extract_quality", f"""
WITH p AS ({PRIM_SQL}), b AS ({GOOD_BACK_SQL}),
j AS (SELECT p.ticker, p.metric, p.raw, b.raw AS braw, {_failed_sql('p.raw')} AS miss,
             {_failed_sql('p.raw')} AND b.ticker IS NOT NULL AND {_failed_sql('b.raw')} AS miss2
      FROM p LEFT JOIN b ON p.ticker = b.ticker AND p.metric = b.metric),
e AS (SELECT *, CASE WHEN raw IS NULL THEN '{E.NO_MATCH}' ELSE '{E.NOT_A_NUMBER}' END AS e1,
             CASE WHEN braw IS NULL THEN '{E.NO_MATCH}' ELSE '{E.NOT_A_NUMBER}' END AS e2 FROM j)
SELECT ticker, CAST(count_if(miss) AS BIGINT) AS n_unmatched,
       coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE miss), '') AS unmatched,
       coalesce(string_agg(DISTINCT e1, ',' ORDER BY e1) FILTER (WHERE miss), '') AS error_types,
       coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE miss2), '') AS backup_unmatched,
       coalesce(string_agg(DISTINCT e2, ',' ORDER BY e2) FILTER (WHERE miss2), '') AS backup_error_types
FROM e GROUP BY ticker""")
def q_extract_quality(spark, sf):
    return E.extract_quality(X.html_metrics(spark, sf), X.html_backup(spark, sf), METRICS)


def _column(metric: str) -> str:
    return re.sub("[^a-z0-9]+", "_", metric.lower()).strip("_")


@register("ticker_record", P._BACK_SQL + f""",
y AS (SELECT l.tk, (round_even(((current - prior) / prior * 100.0) * 100.0, 0) / 100.0 + 0.0) AS year_prior_diff,
             (round_even(((i.sp - sp_prior) / sp_prior * 100.0) * 100.0, 0) / 100.0 + 0.0) AS sp_year_prior
      FROM last l LEFT JOIN index_series i ON i.dt = l.last_dt
      LEFT JOIN (SELECT tk, avg(px) AS prior, avg(sp) AS sp_prior FROM back GROUP BY tk) b USING (tk)),
m AS (SELECT ticker, {', '.join(f"max(value) FILTER (WHERE metric = {_sql_str(m)}) AS {_column(m)}" for m in METRICS)}
      FROM ({FALLBACK_SQL}) f GROUP BY ticker),
s AS ({SECTOR_SQL})
SELECT m.*, s.sector, y.year_prior_diff, y.sp_year_prior, y.year_prior_diff - y.sp_year_prior AS outperformance
FROM m LEFT JOIN s USING (ticker) LEFT JOIN y ON CAST(y.tk AS VARCHAR) = m.ticker""")
def q_ticker_record(spark, sf):
    """One row per ticker: every metric, the sector and the year-prior result (J11, P20, G17 joined)."""
    values = E.fallback(X.html_metrics(spark, sf), X.html_backup(spark, sf), METRICS)
    wide = values.groupBy("ticker").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(_column(m)) for m in METRICS])
    sector = X.sector_html(spark, sf).select("ticker", E.sector_code("html").alias("sector"))
    past = R.year_prior_return(X.series(spark, sf), X.index_series(spark, sf), P.BACK_OFFSETS) \
        .select(F.col("tk").cast("string").alias("ticker"), "year_prior_diff", "sp_year_prior", "outperformance")
    return wide.join(sector, "ticker", "left").join(past, "ticker", "left")


@register("html_catalog", r"""
SELECT page_id, regexp_extract(url, '([^/?#]+?)(\.html?)?([?#].*)?$', 1) AS key,
       regexp_extract(url, '^[a-z]+://[^/]+/([^/]+)/', 1) AS kind, length(html) AS n_chars FROM pages""")
def q_html_catalog(spark, sf):
    p = X.table(spark, sf, "pages")
    return p.select("page_id", E.catalog_key("url").alias("key"),
                    F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/]+)/", 1).alias("kind"),
                    F.length("html").alias("n_chars"))


@register("image_catalog", r"""
SELECT item_id, path, split_part(path, '/', -2) AS class FROM class_items WHERE regexp_matches(lower(path), '(png|jpg|jpeg)$')""")
def q_image_catalog(spark, sf):
    from tessera.sources.files import image_listing
    return image_listing(X.class_items(spark, sf).select("item_id", "path"))
