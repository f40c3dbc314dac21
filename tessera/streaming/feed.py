"""Landed news-feed responses as a stream.

Every new JSON response file becomes a micro-batch; articles are exploded,
empty ones dropped and tokenised with the batch operators.  All steps are
per-row, so no state store is needed and exactly-once output comes from the
file sink's commit log in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import text as TO

FEED_SCHEMA = "articles array<struct<doc_id:bigint, title:string, content:string>>"


def feed_stream(spark: SparkSession, path: str, schema: str = FEED_SCHEMA, max_files: int = 100) -> DataFrame:
    """Streaming DataFrame of non-empty articles from JSON files landing in ``path``."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)
    return TO.nonempty(TO.explode_articles(raw))


def tokenized_feed(spark: SparkSession, path: str, max_length: int = 512) -> DataFrame:
    """The stream with model inputs (ids, mask, labels) attached."""
    return TO.tokenize_pad(feed_stream(spark, path), "content", max_length)


def write_stream(df: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to a parquet table; ``checkpoint`` must be on shared storage on a cluster."""
    w = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint) \
          .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
