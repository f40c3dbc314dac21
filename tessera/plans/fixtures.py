"""Stand-in inputs derived from the bundled tables (see FIXTURES.md, part B).

Each builder reads the parquet tables under ``sf_dir`` and derives the shape a
reference script consumes (price series, a long beta matrix, metadata, HTML
pages, articles, Q/A pairs ...).  Every builder is a pure DataFrame plan, so
its work grows with the input tables.  ``plans.fixture_sql`` holds the same
recipes in DuckDB SQL for the oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.functions.random import uniform
from tessera.operators import extract as EX
from tessera.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- prices
def _cents():
    return F.round(F.col("l_extendedprice") * 100).cast("bigint")


def _unit_price(cents_sum, qty_sum):
    """Exact integer sums, one division: identical in every IEEE engine."""
    return cents_sum / (qty_sum * F.lit(100.0))


def series(spark, sf_dir) -> DataFrame:
    """(tk, dt, px): unit price (revenue / quantity) per supplier and ship day."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_suppkey").alias("tk"), F.to_date("l_shipdate").alias("dt"))
              .agg(_unit_price(F.sum(_cents()), F.sum(F.col("l_quantity").cast("bigint"))).alias("px")))


def index_series(spark, sf_dir) -> DataFrame:
    """(dt, sp): the market index = unit price over all suppliers on a day."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.to_date("l_shipdate").alias("dt"))
              .agg(_unit_price(F.sum(_cents()), F.sum(F.col("l_quantity").cast("bigint"))).alias("sp")))


def nation_series(spark, sf_dir) -> DataFrame:
    """(tk, dt, px): unit price per supplier nation and ship day, some 2,500 days a ticker (long series)."""
    li, sup = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (li.join(sup, li.l_suppkey == sup.s_suppkey)
              .groupBy(F.format_string("n%02d", "s_nationkey").alias("tk"), F.to_date("l_shipdate").alias("dt"))
              .agg(_unit_price(F.sum(_cents()), F.sum(F.col("l_quantity").cast("bigint"))).alias("px")))


NATIONS = list(range(25))


def prices_wide(spark, sf_dir) -> DataFrame:
    """Date x nation price matrix (one column ``n00``..``n24`` per supplier nation)."""
    li = table(spark, sf_dir, "lineitem")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = li.join(sup, li.l_suppkey == sup.s_suppkey)
    wide = (joined.groupBy(F.to_date("l_shipdate").alias("dt"))
                  .pivot("s_nationkey", NATIONS)
                  .agg(_unit_price(F.sum(_cents()), F.sum(F.col("l_quantity").cast("bigint")))))
    return wide.select("dt", *[F.col(str(n)).alias(f"n{n:02d}") for n in NATIONS])


def offsets(spark, sf_dir=None) -> DataFrame:
    """(z, days): the sampling offsets of the prior-year average (parameters)."""
    return spark.createDataFrame([(z, 7 * z) for z in range(1, 9)], "z int, days int")


# ---------------------------------------------------------------- matrix
def shared_folder(spark, name: str) -> str:
    """A new folder beside the checkpoints."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark, path: str) -> None:
    """Remove a folder that a fixture wrote and no longer needs."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cells(spark, sf_dir) -> DataFrame:
    """Long beta matrix (patient_id, feature, beta) from ``embeddings``.

    Every row is in the matrix; two features carry NULL cells.
    """
    emb = table(spark, sf_dir, "embeddings")
    exploded = emb.select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    null_cell = F.col("pos").isin(3, 17) & (F.col("vec_id") % 50 == 0)
    return exploded.select(
        F.col("vec_id").cast("string").alias("patient_id"),
        F.format_string("cg%02d", "pos").alias("feature"),
        F.when(null_cell, F.lit(None).cast("double")).otherwise(F.col("v").cast("double")).alias("beta"))


def _status(label_col, words):
    healthy, lung, heme = words
    return (F.when(F.col("vec_id") % 11 == 0, F.lit(None).cast("string"))
             .when(label_col % 3 == 0, F.lit(healthy))
             .when(label_col % 3 == 1, F.lit(lung))
             .otherwise(F.lit(heme)))


def meta(spark, sf_dir) -> DataFrame:
    """(patient_id, status): free-text disease field, NULL for some patients."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").cast("string").alias("patient_id"),
                      _status(F.col("label"), ("Healthy", "Lung; High Blood Pressure", "Heme")).alias("status"))


def clinic(spark, sf_dir) -> DataFrame:
    """(patient_id, clinic): single-word clinic in mixed case."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").cast("string").alias("patient_id"),
                      _status(F.col("label"), ("Healthy", "LUNG", "heme")).alias("clinic"))


def features(spark, sf_dir) -> DataFrame:
    """Selected-feature list: even positions of the matrix plus two unknown names."""
    present = (cells(spark, sf_dir).select("feature").distinct()
               .filter(F.expr("substring(feature, 3)").cast("int") % 2 == 0))
    unknown = spark.createDataFrame([("cg_absent_1",), ("cg_absent_2",)], "feature string")
    return present.unionByName(unknown)


def cohorts(spark, sf_dir) -> DataFrame:
    """(cohort, patient_id, feature, beta): three external cohorts a/b/c."""
    emb = table(spark, sf_dir, "embeddings")
    exploded = emb.select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    pid = F.when(F.col("vec_id") % 37 == 0, F.concat(F.lit("z"), F.col("vec_id").cast("string"))) \
           .otherwise(F.col("vec_id").cast("string"))
    return exploded.select(
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("vec_id") % 3 + 1).cast("int")).alias("cohort"),
        pid.alias("patient_id"),
        F.format_string("cg%02d", "pos").alias("feature"),
        F.col("v").cast("double").alias("beta"))


def target(spark, sf_dir) -> DataFrame:
    """(patient_id, y): a continuous target, NULL for some patients."""
    emb = table(spark, sf_dir, "embeddings")
    e = lambda i: F.col("embedding")[i].cast("double")
    y = F.lit(30.0) + F.lit(20.0) * e(0) - F.lit(10.0) * e(5) + F.lit(0.5) * F.col("label")
    return emb.select(F.col("vec_id").cast("string").alias("patient_id"),
                      F.when(F.col("vec_id") % 13 == 0, F.lit(None).cast("double")).otherwise(y).alias("y"))


def population(spark, sf_dir) -> DataFrame:
    """(id, pace): a continuous per-person measure."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("pace"))


def disease(spark, sf_dir) -> DataFrame:
    """(id, n): a disease count per person (orders per customer, mod 4)."""
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    per = (table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"))
           .agg(F.count(F.lit(1)).alias("cnt")))
    return (cust.join(per, "id", "left")
                .select("id", (F.coalesce(F.col("cnt"), F.lit(0)) % 4).cast("bigint").alias("n")))


def scores(spark, sf_dir) -> DataFrame:
    """(id, y, p): binary truth and a score correlated with it."""
    emb = table(spark, sf_dir, "embeddings")
    y = (F.col("label") > 4).cast("int")
    p = F.lit(0.7) * uniform("scores", "vec_id") + F.lit(0.3) * y
    return emb.select(F.col("vec_id").alias("id"), y.alias("y"), p.alias("p"))


def preds(spark, sf_dir) -> DataFrame:
    """(id, y, yhat): regression truth and a noisy prediction."""
    t = target(spark, sf_dir).filter(F.col("y").isNotNull())
    return t.select(F.col("patient_id").alias("id"), "y",
                    (F.col("y") + (uniform("preds", "patient_id") - F.lit(0.5)) * F.lit(4.0)).alias("yhat"))


# ---------------------------------------------------------------- pages
# Metrics carried by the stand-in pages (the metric list is a parameter of the extractor).
METRICS = ["Trailing P/E", "Price/Sales", "Revenue", "Total Debt/Equity", "Enterprise Value", "Market Cap"]
# The page markers, sector names and backup-site aliases are the operator's fixed values.
BACKUP_ALIAS = EX.BACKUP_ALIAS
SORRY = EX.NO_DATA_MARKER
SECTORS = EX.SECTORS
SUFFIXES = ["", "K", "M", "T"]


def _metric_value(j: int) -> F.Column:
    base = (F.col("p_retailprice") * F.lit(j + 1)).cast("decimal(14,2)").cast("string")
    if j == 3:   # thousands separator on one metric
        base = F.concat(F.col("p_size").cast("string"), F.lit(",500"))
    sfx = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), ((F.col("p_partkey") + j) % 4 + 1).cast("int"))
    return F.concat(base, sfx)


def html_metrics(spark, sf_dir) -> DataFrame:
    """(ticker, html) primary fundamentals page per part."""
    part = table(spark, sf_dir, "part")
    rows = []
    for j, m in enumerate(METRICS):
        val = _metric_value(j)
        if m == "Price/Sales":
            val = F.when(F.col("p_partkey") % 10 == 0, F.lit("N/A")).otherwise(val)
        row = F.concat(F.lit(f"<tr><td>{m}</td><td><span>"), val, F.lit("</span></td></tr>\n"))
        if m == "Revenue":
            row = F.when(F.col("p_partkey") % 9 == 0, F.lit("")).otherwise(row)
        if m == "Market Cap":
            row = F.when(F.col("p_partkey") % 6 == 0, F.lit("")).otherwise(row)
        rows.append(row)
    body = F.concat(F.lit("<html><body><table>"), *rows, F.lit("</table>"),
                    F.when(F.col("p_partkey") % 17 == 0, F.lit(f"<p>{SORRY}.</p>")).otherwise(F.lit("")),
                    F.lit("</body></html>"))
    return part.select(F.col("p_partkey").cast("string").alias("ticker"), body.alias("html"))


def html_backup(spark, sf_dir) -> DataFrame:
    """(ticker, html) backup page with the site's alias names and bold cells."""
    part = table(spark, sf_dir, "part")
    rows = []
    for j, m in enumerate(METRICS):
        alias = BACKUP_ALIAS.get(m, m) or m
        val = F.when(F.col("p_partkey") % 8 == 0, F.lit("-")).otherwise(_metric_value(j))
        rows.append(F.concat(F.lit(f"<tr><td>{alias}</td><td><b>"), val, F.lit("</b></td></tr>\n")))
    bad = F.when(F.col("p_partkey") % 13 == 0, F.lit("<p>Ticker not found</p>")).otherwise(F.lit(""))
    body = F.concat(F.lit("<html><body><table>"), *rows, F.lit("</table>"), bad, F.lit("</body></html>"))
    return part.select(F.col("p_partkey").cast("string").alias("ticker"),
                                                           body.alias("html"))


def sector_html(spark, sf_dir) -> DataFrame:
    """(ticker, html) company-type page naming one sector (or none)."""
    part = table(spark, sf_dir, "part")
    idx = (F.col("p_partkey") % 12).cast("int")
    name = F.element_at(F.array(*[F.lit(s) for s in SECTORS]), idx + 1)
    span = F.when(idx < 11, F.concat(F.lit('<span class="sector">'), name, F.lit("</span>"))) \
            .otherwise(F.lit("<span>Unknown</span>"))
    return part.select(F.col("p_partkey").cast("string").alias("ticker"),
                       F.concat(F.lit("<div>"), span, F.lit("</div>")).alias("html"))


# ---------------------------------------------------------------- text
def articles(spark, sf_dir) -> DataFrame:
    """(doc_id, title, content) news-feed records."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id",
                    F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"))


def qa(spark, sf_dir) -> DataFrame:
    """(conv_id, turn, question, answer): a user turn and the assistant reply."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = c.select("conv_id", "turn", "role", "text",
                   F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    return (nxt.filter((F.col("role") == "user") & (F.col("next_role") == "assistant"))
               .select("conv_id", "turn", F.col("text").alias("question"), F.col("next_text").alias("answer")))


def labelled_docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


EXTENSIONS = [".png", ".PNG", ".jpg", ".jpeg", ".txt"]


def class_items(spark, sf_dir) -> DataFrame:
    """(item_id, class, path): catalogue of items per class (images stand-in)."""
    p = table(spark, sf_dir, "part")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("class"),
                    F.concat(F.lit("/graphs/"), F.col("p_type"), F.lit("/"), F.col("p_partkey").cast("string"),
                             ext).alias("path"))
