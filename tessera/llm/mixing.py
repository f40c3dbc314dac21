"""Mixing sources to target weights by capped water-filling.

The total of all sizes is shared out by weight.  A source whose share exceeds
``max_epochs`` times its size is clamped there, and the excess is shared again by
weight among the others until none is above.  In closed form: with the sources
sorted by cap / weight, the level is the first ``(total - caps so far) / (weights
left)`` that the next source's cap / weight does not stay under.

A source that is to be taken r times gives every document floor(r) whole times,
and once more the documents that come first in a seeded md5 order, until the rest
of the target is met (the crossing document goes to the nearer side).  That order
needs no sort of a whole source: sizes are summed by (source, first 4 hex digits
of the md5), running sums over those 65,536 bins find the bin where the target is
crossed, and only the rows of that one bin per source are ordered.

Defined cases: a null text has size 0; sources are ordered by code point, null
last; rows that agree in id and text share their fate; an empty table gives an
empty result; documents of size 0 follow the same rule and take no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import n_words_of, text_of
from tessera.session import cut_lineage

MAX_EPOCHS, WEIGHTS, SEED = 3, (1, 2, 3), "mix-1"
#: One row per source, about 100 bytes each, is broadcast up to this many sources.
BROADCAST_SOURCES = 100_000
_BIN_DIGITS = 4


def draw_key(seed: str, doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(text)))


def targets(sizes: DataFrame, max_epochs: float = MAX_EPOCHS, weights=WEIGHTS) -> DataFrame:
    """(source, source_size) -> with ``target``.  One row per source, so the windows over all
    sources are bounded by their number, not by the documents."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
    by_level = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the first source in that order whose cap the level stays under fixes the level
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(
        F.row_number().over(by_level).alias("i"), F.col("level").alias("level")))).over(every)["level"])
    return s.select("source", "source_size", F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("w")).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
         max_epochs: float = MAX_EPOCHS, weights=WEIGHTS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, times (repetitions of the whole document), taken, draw."""
    t = text_of(text)
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source).alias("source"), n_words_of(t).alias("size"),
        draw_key(seed, F.col(id_col), t).alias("draw")))
    goal = cut_lineage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), max_epochs, weights))
    n_sources = goal.count()
    goal = goal.withColumn("whole", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(
        F.floor(F.col("target") / F.col("source_size")).cast("double"))) \
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    here = F.substring("draw", 1, _BIN_DIGITS)
    bins = rows.groupBy("source", here.alias("bin")).agg(F.sum("size").alias("n"))
    run = Window.partitionBy("source").orderBy("bin")
    g = goal.withColumnsRenamed({"source": "g_source"})
    same = F.col("source").eqNullSafe(F.col("g_source"))
    cross = bins.withColumn("before", F.sum("n").over(run) - F.col("n")) \
        .join(g.select("g_source", "rest"), same) \
        .filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest"))) \
        .groupBy("g_source").agg(F.min(F.struct("bin", "before")).alias("x")) \
        .select(F.col("g_source").alias("x_source"), F.col("x.bin").alias("x_bin"), F.col("x.before").alias("x_before"))
    goal = goal.join(cross, F.col("source").eqNullSafe(F.col("x_source")), "left").drop("x_source")
    goal = goal.withColumnRenamed("source", "g_source")
    if n_sources <= BROADCAST_SOURCES:  # else a shuffle join, whose skewed side Spark can split
        goal = F.broadcast(goal)
    tagged = rows.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    inside = here == F.col("x_bin")
    # rows of a source's one crossing bin, about 1 in 65,536 of its documents; equal draws are peers
    order = Window.partitionBy("source").orderBy("draw").rangeBetween(Window.unboundedPreceding, 0)
    peers = Window.partitionBy("source", "draw")
    cols = ["doc_id", "source", "size", "source_size", "target", "whole", "draw"]
    edge = tagged.filter(inside).withColumn("upto", F.col("x_before") + F.sum("size").over(order)) \
        .withColumn("from", F.col("upto") - F.sum("size").over(peers)) \
        .withColumn("more", (F.col("from") + F.col("upto")) <= 2 * F.col("rest"))
    plain = tagged.filter(F.coalesce(~inside, F.lit(True))) \
        .withColumn("more", F.coalesce(here < F.col("x_bin"), F.lit(False)))
    out = plain.select(*cols, "more").unionByName(edge.select(*cols, "more"))
    # a target equal to 3 times its source is exactly 3 whole repetitions
    times = F.col("whole").cast("bigint") + F.when(F.col("more"), 1).otherwise(0)
    return out.withColumn("times", F.least(times, F.lit(int(max_epochs)).cast("bigint"))) \
        .withColumn("taken", F.col("times") * F.col("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
        max_epochs: float = MAX_EPOCHS, weights=WEIGHTS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the plan takes it, with their own columns only."""
    p = plan(docs, id_col, text, source, max_epochs, weights, seed).filter("times > 0")
    p = p.groupBy("draw").agg(F.max("times").alias("times"))
    tagged = docs.select(F.struct("*").alias("row"), draw_key(seed, F.col(id_col), text_of(text)).alias("draw"))
    return tagged.join(p, "draw").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")).alias("copy")).select("row.*")


_SQL_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
#: DuckDB: water-filling as the closed form, then running sums in md5 order.
PLAN_SQL = rf"""
with rows_ as (select doc_id, source, {_SQL_SIZE} size,
    md5('{SEED}|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))) draw from DOCS),
src as (select source, sum(size)::double ss from rows_ group by source),
w as (select *, [1.0, 2.0, 3.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double w, 3.0 * ss cap from src),
l as (select *, (sum(ss) over () - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) lv,
    row_number() over (order by cap / w, source nulls last) i
    from w window b as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
m as (select *, (select min_by(lv, i) from l where lv * w <= cap) level from l),
g as (select source, ss, least(cap, coalesce(level, 0) * w) target from m),
h as (select *, case when ss = 0 then 0 else floor(target / ss) end whole from g),
r as (select rows_.*, h.ss, h.target, h.whole, h.target - h.whole * h.ss rest,
    sum(size) over (partition by rows_.source order by draw range between unbounded preceding and current row) upto,
    sum(size) over (partition by rows_.source, draw) own
  from rows_ join h on rows_.source is not distinct from h.source)
"""
OP8_SQL = PLAN_SQL.replace("DOCS", "documents") + """
select doc_id, size::bigint size, ss::bigint source_size, round(target, 6) target,
  (least(3, whole + case when 2 * upto - own <= 2 * rest then 1 else 0 end) * size)::bigint taken from r
"""
