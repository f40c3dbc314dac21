"""Fundamentals extraction from HTML pages.

Pages are rows ``(ticker, html)``.  The metric list is a small parameter, so
each metric becomes one literal ``regexp_extract`` expression (compiled once
per task) and the per-metric columns are unpivoted to long rows: no join of
pages against metrics and no per-row regex compilation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Value patterns that follow '>' + metric name on each site.
PRIMARY_TAIL = r".*?(\S*\d{1,8}(\.\d{1,8})?T?B?M?K?|N/A|0)%?(</span>)?</td></tr>"
BACKUP_TAIL = r".*?(\S*(\d{1,8}|\-)(\.\d{1,8})?T?B?M?K?|N/A|0)%?(</span>)?</b></td>"
# Page markers.
NO_DATA_MARKER = "We're sorry we weren't able to find anything about this topic"
BAD_BACKUP_MARKERS = ["not found", "no results", "found in screener"]
# Sector names in code order 0..10 (anything else matched is 11).
SECTORS = ["Healthcare", "Basic Materials", "Technology", "Consumer Defensive", "Industrials",
           "Utilities", "Consumer Cyclical", "Financial Services", "Real Estate", "Energy",
           "Communication Services"]
SECTOR_PATTERN = '">(' + "|".join(SECTORS) + ")</span>"
# Primary metric name -> backup-site name (None: no backup value).
BACKUP_ALIAS = {
    "Total Debt/Equity": "Total Debt to Equity",
    "Trailing P/E": "P/E",
    "Price/Sales": "P/S",
    "Price/Book": "P/B",
    "PEG Ratio": "PEG",
    "Revenue": "Revenue (ttm)",
    "Gross Profit": "Gross Margin",
    "Net Income Avi to Common": "Net Profit",
    "Enterprise Value/Revenue": None,
    "Enterprise Value/EBITDA": None,
    "Enterprise Value": None,
    "EBITDA": None,
    "Cash Flow": None,
}


#: Kinds of extraction errors: nothing found, or an abbreviated number that cannot be read.
NO_MATCH, NOT_A_NUMBER = "no match", "not a number"


def _failed(raw: str, value: Column) -> Column:
    """No text found, or text with a magnitude letter whose number cannot be read."""
    return F.col(raw).isNull() | (F.element_at(F.split(F.col(raw), ">"), -1).rlike("[TBMK]") & value.isNull())


def _bad_backup(html: str) -> Column:
    out = F.lit(False)
    for m in BAD_BACKUP_MARKERS:
        out = out | F.col(html).contains(m)
    return out


def metric_regex(name: str, tail: str = PRIMARY_TAIL) -> str:
    """'>' + the literal name (quoted with \\Q..\\E) + the value pattern."""
    return ">\\Q" + name + "\\E" + tail


def extract_metrics(pages: DataFrame, metrics: Sequence[str], tail: str = PRIMARY_TAIL,
                    names: Mapping[str, str] | None = None, key: str = "ticker",
                    html: str = "html") -> DataFrame:
    """Long ``(key, metric, raw)``: the captured value text, NULL when no match.

    ``names`` maps a metric to the label searched on the page (site aliases).
    """
    names = names or {}
    cols = []
    for m in metrics:
        raw = F.regexp_extract(F.col(html), metric_regex(names.get(m, m), tail), 1)
        cols.append(F.struct(F.lit(m).alias("metric"), F.nullif(raw, F.lit("")).alias("raw")))
    return pages.select(key, F.explode(F.array(*cols)).alias("_m")).select(key, "_m.metric", "_m.raw")


def clean_number(raw) -> Column:
    """Text after the last '>', commas removed, T/B/M/K scaled, '-' and N/A -> NULL."""
    v = F.element_at(F.split(raw if isinstance(raw, Column) else F.col(raw), ">"), -1)
    v = F.regexp_replace(v, ",", "")

    def num(letter: str | None, scale: float) -> Column:
        txt = v if letter is None else F.regexp_replace(v, letter, "")
        return txt.try_cast("double") * F.lit(scale)

    return (F.when(v.contains("T"), num("T", 1e12)).when(v.contains("B"), num("B", 1e9))
             .when(v.contains("M"), num("M", 1e6)).when(v.contains("K"), num("K", 1e3))
             .otherwise(num(None, 1.0)))


def page_status(primary: DataFrame, backup: DataFrame, key: str = "ticker", html: str = "html") -> DataFrame:
    """Per entity: primary page usable / no data; backup ok / bad / missing."""
    p = primary.select(key, F.when(F.col(html).contains(NO_DATA_MARKER), F.lit("no_data"))
                       .otherwise(F.lit("ok")).alias("primary_status"))
    b = backup.select(key, F.when(_bad_backup(html), F.lit("bad")).otherwise(F.lit("ok")).alias("backup_status"))
    return p.join(b, key, "left").fillna({"backup_status": "missing"})


def fallback(primary: DataFrame, backup: DataFrame, metrics: Sequence[str],
             alias: Mapping[str, str | None] = BACKUP_ALIAS, key: str = "ticker", html: str = "html") -> DataFrame:
    """Per (entity, metric): the primary value, else the backup site's value.

    Pages flagged "no data" yield nothing at all.  Metrics whose alias is None
    have no backup.  ``source`` tells which page the value came from.
    """
    usable = primary.filter(~F.col(html).contains(NO_DATA_MARKER))
    prim = extract_metrics(usable, metrics, PRIMARY_TAIL, key=key, html=html) \
        .withColumn("primary", clean_number("raw")).withColumnRenamed("raw", "primary_raw")
    with_backup = [m for m in metrics if alias.get(m, m) is not None]
    names = {m: (alias.get(m, m) or m) for m in with_backup}
    back = extract_metrics(backup, with_backup, BACKUP_TAIL, names=names, key=key, html=html) \
        .withColumn("backup", clean_number("raw")).withColumnRenamed("raw", "backup_raw")
    j = prim.join(back, [key, "metric"], "left")
    # text whose number cannot be read counts as missed, as on the page itself
    use_backup = _failed("primary_raw", F.col("primary")) & F.col("backup_raw").isNotNull()
    return j.select(key, "metric",
                    F.when(use_backup, F.col("backup")).otherwise(F.col("primary")).alias("value"),
                    F.when(~_failed("primary_raw", F.col("primary")), F.lit("primary"))
                     .when(use_backup, F.lit("backup")).alias("source"))


def sector_code(html) -> Column:
    """0..10 by sector name, 11 for another match, NULL when no sector is found."""
    name = F.nullif(F.regexp_extract(html if isinstance(html, Column) else F.col(html), SECTOR_PATTERN, 1), F.lit(""))
    idx = F.array_position(F.array(*[F.lit(s) for s in SECTORS]), name)
    return F.when(name.isNull(), F.lit(None).cast("int")).when(idx > 0, (idx - 1).cast("int")).otherwise(F.lit(11))


def extract_quality(primary: DataFrame, backup: DataFrame, metrics: Sequence[str],
                    alias: Mapping[str, str | None] = BACKUP_ALIAS, key: str = "ticker",
                    html: str = "html") -> DataFrame:
    """Per entity: metrics missed on the primary page and missed again on the backup, with the
    kinds of errors.  An entity without a backup page, or with a bad one, has no second report."""
    usable = primary.filter(~F.col(html).contains(NO_DATA_MARKER))
    prim = extract_metrics(usable, metrics, PRIMARY_TAIL, key=key, html=html)
    with_backup = [m for m in metrics if alias.get(m, m) is not None]
    names = {m: (alias.get(m, m) or m) for m in with_backup}
    back = extract_metrics(backup.filter(~_bad_backup(html)), with_backup, BACKUP_TAIL, names=names, key=key, html=html) \
        .withColumnRenamed("raw", "braw").withColumn("there", F.lit(True))
    j = prim.join(back, [key, "metric"], "left")
    miss = _failed("raw", clean_number("raw"))
    miss2 = miss & F.col("there").isNotNull() & _failed("braw", clean_number("braw"))
    error = lambda raw: F.when(F.col(raw).isNull(), F.lit(NO_MATCH)).otherwise(F.lit(NOT_A_NUMBER))
    listed = lambda cond, c, agg: F.array_join(F.array_sort(agg(F.when(cond, c))), ",")
    return j.groupBy(key).agg(
        F.count_if(miss).alias("n_unmatched"),
        listed(miss, F.col("metric"), F.collect_list).alias("unmatched"),
        listed(miss, error("raw"), F.collect_set).alias("error_types"),
        listed(miss2, F.col("metric"), F.collect_list).alias("backup_unmatched"),
        listed(miss2, error("braw"), F.collect_set).alias("backup_error_types"))


def catalog_key(path) -> Column:
    """Entity key from a file name or URL: last path segment without extension/query."""
    return F.regexp_extract(path if isinstance(path, Column) else F.col(path), r"([^/?#]+?)(\.html?)?([?#].*)?$", 1)
