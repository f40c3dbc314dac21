"""One query per operator, over the whole of its tables, and their DuckDB twins."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship_package

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register("op1_token_output")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import tokens
    return tokens.encode(table(spark, sf_dir, "documents"), word_tokenizer())


@register("op2_decontaminate")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import decontam
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op3_kdtree_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import kdtree
    return kdtree.shard(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP4_SQL = r"""
with l as (select doc_id, generate_subscripts(x, 1) i, unnest(x) line from (select doc_id, string_split(coalesce(text, ''), chr(10)) x from documents)),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
often as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
m as (select k.*, often.key is not null gone from k left join often using (key))
select doc_id, count(*) n_lines, sum(gone::bigint)::bigint n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256 from m group by doc_id
"""


@register("op4_line_dedup", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import linededup
    out = linededup.drop_frequent(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@register("op5_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import pii
    out = pii.find(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
                      F.array_join(F.concat("base", "added"), ",").alias("spans"), F.size("added").cast("bigint").alias("n_added"),
                      (F.size("base") + F.size("added")).cast("bigint").alias("n_spans"))


@register("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import urls
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


@register("op7_forest_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import forest
    return forest.classes(table(spark, sf_dir, "documents")).drop("h", "leads")


def _op8_sql() -> str:
    from tessera.llm import mixing
    return mixing.OP8_SQL


@register("op8_mix_sources", _op8_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import mixing
    return mixing.plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), F.round("target", 6).alias("target"), "taken")


OP9_SQL = r"""
with w as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select *, len(w)::bigint n, [w[i] || ' ' || w[i+1] || ' ' || w[i+2] for i in range(1, len(w) - 1)] g from w),
r as (select doc_id, p from (select doc_id, unnest(g) x, generate_subscripts(g, 1) p from g)
      qualify count(*) over (partition by doc_id, x) > 1),
c as (select doc_id, count(distinct q)::bigint n_repeat_words from (select doc_id, unnest([p, p + 1, p + 2]) q from r) group by doc_id),
d as (select doc_id, sum(n - 1)::bigint n_dup from (select doc_id, line, count(*) n from
      (select doc_id, unnest(string_split(t, chr(10))) line from w) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1, 2) group by 1),
s as (select g.doc_id, n n_words, (select coalesce(sum(length(x)), 0) from unnest(w) u(x))::bigint word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, coalesce(n_dup, 0) n_dup_lines,
  coalesce(n_repeat_words, 0) n_repeat_words,
  len(list_filter(w, lambda x: list_contains(STOPS, x))) stops,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) lines
  from g left join c using (doc_id) left join d using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars >= 2 * n_words and word_chars <= 14 * n_words and n_symbols::double / n_words <= 0.1
  and stops::double / n_words >= 0.01 and n_dup_lines::double / lines <= 0.5 kept from b
"""


def _op9_sql() -> str:
    from tessera.llm import quality
    return OP9_SQL.replace("STOPS", repr(list(quality.STOP_WORDS)))


@register("op9_quality_rules", _op9_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import quality
    return quality.report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op10_run_index_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import rindex
    out = rindex.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _twin(module: str, name: str) -> str:
    import importlib
    return getattr(importlib.import_module(f"tessera.llm.{module}"), name)


@register("op11_filter_audit", _twin("filteraudit", "OP11_SQL"))
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import filteraudit
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op12_vector_codes", _twin("vectorcodes", "OP12_SQL"))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import vectorcodes
    return vectorcodes.compress(table(spark, sf_dir, "embeddings")).drop("label")


@register("op13_best_fit_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import packing
    return packing.pack(table(spark, sf_dir, "documents"), byte_tokenizer())


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
