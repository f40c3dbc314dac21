"""File sources and sinks.

Readers return long/narrow DataFrames; nothing is read to the driver.  Wide
matrices are read as text lines and turned into long cells with
``posexplode`` so a file with 10^5 columns never becomes a 10^5-column
DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException

from tessera.operators.extract import catalog_key

IMAGE_PATTERN = r"(png|jpg|jpeg)$"
# Charsets Spark 4 accepts without the legacy switch.
_STANDARD_CHARSETS = {"iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8"}


def read_table(spark: SparkSession, path, schema: StructType | str | None = None, encoding: str = "UTF-8",
               key: str | None = None, sep: str = ",") -> DataFrame:
    """CSV with a header row (S1/S2).  Pass ``schema`` in production (no
    inference pass).  ``key`` renames the anonymous first column (``_c0``)."""
    if encoding.lower() not in _STANDARD_CHARSETS:
        # e.g. windows-1252 metadata exports: any JVM charset needs the legacy switch
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.option("header", True).option("encoding", encoding).option("sep", sep) \
                  .option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    if key and "_c0" in df.columns:
        df = df.withColumnRenamed("_c0", key)
    return df


def _lines(spark, path):
    # an unreadable file is an error; ``read_chunks`` finds and reports such files beforehand
    return spark.read.option("ignoreCorruptFiles", False).text(path) \
                .select(F.col("value"), F.col("_metadata.file_path").alias("_file"))


def read_matrix(spark: SparkSession, path, rows_are: str = "patients", key_header: str = "",
                sep: str = ",") -> DataFrame:
    """Wide CSV matrix (first column = row key, header = column keys) -> long
    ``(patient_id, feature, beta)`` cells (S4).

    Each file's header line is the line whose first cell equals ``key_header``
    (pandas writes an empty one).  ``rows_are='features'`` transposes, which for
    long cells is only a swap of the two key columns; ``'auto'`` applies the
    reference rule (transpose when there are fewer columns than rows).
    """
    lines = _lines(spark, path).withColumn("_cells", F.split("value", sep, -1))
    first = F.col("_cells")[0]
    header = lines.filter(first == key_header).select("_file", F.slice("_cells", 2, 1 << 30).alias("_names"))
    data = lines.filter((first != key_header) & (F.length("value") > 0))
    data = data.select("_file", first.alias("_rk"), F.slice("_cells", 2, 1 << 30).alias("_vals"))
    j = data.join(header, "_file")   # one header row per file
    long = j.select("_rk", F.explode(F.arrays_zip("_names", "_vals")).alias("_z")) \
            .select("_rk", F.col("_z._names").alias("_ck"),
                    F.nullif(F.trim(F.col("_z._vals")), F.lit("")).try_cast("double").alias("beta"))
    if rows_are == "auto":
        from tessera.operators.matrix import orientation
        o = orientation(long, "_rk", "_ck").first()
        rows_are = "features" if o["transpose"] else "patients"
    if rows_are == "features":
        return long.select(F.col("_ck").alias("patient_id"), F.col("_rk").alias("feature"), "beta")
    return long.select(F.col("_rk").alias("patient_id"), F.col("_ck").alias("feature"), "beta")


def read_chunks(spark: SparkSession, paths: Sequence[str], **kw) -> tuple[DataFrame | None, list[str]]:
    """Column-chunk files of one matrix -> (union of long cells, unreadable paths) (S6).

    Each file is read to its end once beforehand, so a missing or damaged one is reported
    and gives no cells at all.

    Side-by-side concatenation on the key is a plain union in long form."""
    good, bad = [], []
    for p in paths:
        try:
            spark.read.option("ignoreCorruptFiles", False).text(p).select(F.sum(F.length("value"))).collect()
            good.append(p)
        except (AnalysisException, Py4JJavaError, PySparkException):
            bad.append(p)
    cells = read_matrix(spark, good, **kw) if good else None
    return cells, bad


def html_catalog(spark: SparkSession, dirs: Mapping[str, str], optional: Sequence[str] = ("backup", "type")) -> DataFrame:
    """Per-entity HTML files in several directories -> ``(ticker, kind, html)`` (S7).

    One row per file (``wholetext``); the key is the file name without
    ``.html``; a missing file is simply an absent row (left-join it); a missing
    directory is an error unless its kind is ``optional``."""
    parts = []
    for kind, d in dirs.items():
        try:
            df = spark.read.option("pathGlobFilter", "*.html").text(d, wholetext=True)
        except AnalysisException:
            if kind not in optional:
                raise
            continue
        parts.append(df.select(catalog_key(F.col("_metadata.file_name")).alias("ticker"), F.lit(kind).alias("kind"),
                               F.col("value").alias("html")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def image_listing(listing: DataFrame, path: str = "path", pattern: str = IMAGE_PATTERN) -> DataFrame:
    """Keep image files (extension matched case-insensitively, no dot needed)
    and label each with its parent directory."""
    return (listing.filter(F.lower(F.col(path)).rlike(pattern))
                   .withColumn("class", F.element_at(F.split(F.col(path), "/"), -2)))


def image_catalog(spark: SparkSession, root: str, pattern: str = IMAGE_PATTERN) -> DataFrame:
    """Labelled image directory -> ``(path, length, class)`` (S8).

    Only metadata columns are selected, so the binary file source never reads
    the image bytes."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return image_listing(df.select("path", "length"), "path", pattern)


def read_feed(spark: SparkSession, path, schema: StructType | str | None = None) -> DataFrame:
    """Landed JSON feed responses -> one row per article (S9)."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    raw = reader.json(path)
    return raw.select(F.explode("articles").alias("_a")).select("_a.*")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite", header: bool = True) -> None:
    """Sink (S11/S12).  Parquet by default; CSV keeps a header row."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", header)
    w.format(fmt).save(path)
