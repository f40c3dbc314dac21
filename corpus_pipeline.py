"""A corpus pipeline: each stage works on all that the stage before kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's ``docs``.  All
stages but the last return the columns of ``documents``.

quality    rows that fail the rules go (null text: no words, goes)
near_dups  one document of each near-duplicate class stays (the smallest doc_id)
decontam   documents that hold a test item go
mix        each document as often as its source's target takes it
tokens     packed token ids, read back: doc_id, start, n_tokens, ids_crc32

Defined cases: a null text is empty and goes at the first stage; a row is known by its doc_id and
its text together, so rows that share an id, or have none, stay or go by their own text; repeated
rows are copies, of which one stays; ties go to the smaller doc_id (null first), then the smaller text
hash; long texts are read whole; further columns, whatever their names, are carried to the last stage; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, forest, mixing, quality, tokens
from tessera.llm.common import prepare, written
from tessera.llm.queries import table, word_tokenizer


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def _near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return forest.keep(docs)


def _decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep(docs, table(spark, sf_dir, "benchmark"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.encode(docs, word_tokenizer())


def _shipped(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        return stage(spark, docs, sf_dir)
    return run


STAGES = [("quality", _shipped(_quality)), ("near_dups", _shipped(_near_dups)), ("decontam", _shipped(_decontam)),
          ("mix", _shipped(_mix)), ("tokens", _shipped(_tokens))]

#: Near duplicates, alignment and the tokenizer have no SQL form; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
