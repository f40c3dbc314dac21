"""K-d tree sharding: weighted medians along the widest metadata dimension.

A node that has to give k shards is split where floor(k/2)/k of its bytes lie on
the left, along the dimension in which it is widest, until every node is one
shard.  The dimensions are the size and the metadata columns asked for (by default
language and source; equal texts take the smallest of theirs), each mapped to [0, 1).

Inside a node rows stand in one order: bin of the dimension (4,096), hash of the
text (two digits of 4,096), hash of the row (4,096).  So equal texts are neighbours.
The cut goes to the boundary between texts nearest to the median; only where that
misses it by more than half of ``whole_group`` of a shard (a group of equal texts too
heavy for either side) does it go through the group, by the hash of the row.  A cut
parts one group at most; all other groups stay whole, whatever they weigh.

No level sorts or moves rows: the cuts of all nodes of a level come from a histogram
of bytes per digit, each over the rows that the digits before it left open.  What comes
to the driver is one row per node and bin: at most shards x 4,096, at any input.

Defined cases: a null text weighs 16 bytes and counts as empty; null metadata is
a value of its own; equal rows (id and text) share shard and sit side by side, with slots
of their own; texts of any length weigh their bytes, and one heavier than a shard makes its
shard as heavy; metadata columns that are missing are left out, further columns are not
read, whatever their names; ties of distance go to the smaller cut; an empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_of
from tessera.operators.ranking import global_rank
from tessera.session import cut_lineage

BINS = 4096
DIGITS = 4
HOT = 1024
ROW_BYTES = 16


def _unit(h: Column) -> Column:
    """A 64-bit hash as a number in [0, 1)."""
    return (h.bitwiseAND(F.lit((1 << 62) - 1)).cast("double")) / float(2 ** 62)


def _one_place(base: DataFrame, metas: list[str]) -> DataFrame:
    """``base`` with g_<meta>: the smallest of its text's, so equal texts share one.

    Only texts whose rows differ need a join; those with more than one row in ``HOT`` of all (so
    fewer than ``HOT`` texts) are broadcast and their rows not shuffled."""
    differs = [(F.min(m) != F.max(m)) | ((F.count(m) > 0) & (F.count(m) < F.count(F.lit(1)))) for m in metas]
    any_differs = functools.reduce(lambda a, b: a | b, [F.coalesce(d, F.lit(False)) for d in differs])
    groups = cut_lineage(base.groupBy("h").agg(F.count(F.lit(1)).alias("n"), any_differs.alias("mixed"), *[F.min(m).alias(f"g_{m}") for m in metas])
                         .filter("mixed").drop("mixed"))
    busy = base.count() / HOT
    hot, rest = groups.filter(F.col("n") > busy).drop("n"), groups.filter(F.col("n") <= busy).withColumn("found", F.lit(True)).drop("n")
    cold = base.join(F.broadcast(hot.select("h")), "h", "left_anti").join(rest, "h", "left") \
        .select(*base.columns, *[F.when(F.col("found"), F.col(f"g_{m}")).otherwise(F.col(m)).alias(f"g_{m}") for m in metas])
    return cold.unionByName(base.join(F.broadcast(hot), "h").select(*cold.columns)).drop(*metas)


def points(docs: DataFrame, dims: list[str], id_col: str, text: str) -> DataFrame:
    """One narrow row per document: size, hashes of text and row in [0, 1), coordinates c0, c1, ..."""
    t = text_of(text)
    base = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(t) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("h"),
        *[F.col(d).cast("string").alias(f"m{i}") for i, d in enumerate(dims)]))
    big = math.log2((base.agg(F.max("size")).first()[0] or 0) + 2)
    metas = [f"m{i}" for i in range(len(dims))]
    if metas:
        base = _one_place(base, metas)
    base = base.withColumn("row_h", F.xxhash64("doc_id", "h"))
    coords = [F.log2(F.col("size") + 1) / big] + [_unit(F.xxhash64(F.coalesce(F.col(f"g_{m}"), F.lit("\x00")))) for m in metas]
    return cut_lineage(base.select("doc_id", "size", "text_crc32", "row_h", _unit(F.col("h")).alias("at"), _unit(F.xxhash64("row_h")).alias("row_at"),
                                   *[c.alias(f"c{i}") for i, c in enumerate(coords)]))


def _per_node(values: list, kind: str) -> Column:
    """The literal that belongs to a row's node."""
    return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("node"))


def _bin(dims: list[str], widest: list[tuple]) -> Column:
    """Bin of a row along the widest dimension of its node."""
    x = F.get(F.array(*dims), _per_node([d for d, _, _ in widest], "int"))
    scale = [BINS / (hi - lo) if hi > lo else 0.0 for _, lo, hi in widest]
    at = F.floor((x - _per_node([lo for _, lo, _ in widest], "double")) * _per_node(scale, "double")).cast("int")
    return F.greatest(F.least(at, F.lit(BINS - 1)), F.lit(0))


def _place(dims: list[str], widest: list[tuple]) -> Column:
    """A row's place in the order of its node: four digits of 4,096."""
    digits = [_bin(dims, widest), F.floor(F.col("at") * BINS), F.floor(F.col("at") * BINS * BINS) % BINS, F.floor(F.col("row_at") * BINS)]
    place = F.lit(0).cast("bigint")
    for d in digits:
        place = place * BINS + d.cast("bigint")
    return place


def _cuts(pts: DataFrame, gives: list[int], slack: float, near: float) -> list[int]:
    """The place at which each node is cut: rows before it go left."""
    n = len(gives)
    goal, before, prefix = [0.0] * n, [0] * n, [0] * n
    best = [(math.inf, 0)] * n  # distance from the goal, place
    open_ = [k > 1 for k in gives]
    for digit in range(DIGITS):
        shift = 12 * (DIGITS - 1 - digit)
        rows = pts if digit == 0 else pts.filter(F.shiftright("place", shift + 12) == _per_node([p if o else -1 for p, o in zip(prefix, open_)], "bigint"))
        hist = np.zeros((n, BINS), np.int64)
        for r in rows.groupBy("node", F.shiftright("place", shift).bitwiseAND(F.lit(BINS - 1)).cast("int").alias("d")) \
                .agg(F.sum("size").alias("w")).collect():
            hist[r["node"], r["d"]] = r["w"]
        for i in range(n):
            if not open_[i]:
                continue
            steps = before[i] + np.concatenate([[0], np.cumsum(hist[i])])
            if digit == 0:
                goal[i] = int(steps[-1]) * (gives[i] // 2) / gives[i]
            j = int(np.argmin(np.abs(steps - goal[i])))
            best[i] = min(best[i], (float(abs(steps[j] - goal[i])), (prefix[i] * BINS + j) << shift))
            cross = max(0, min(int(np.searchsorted(steps[1:], goal[i])), BINS - 1))
            before[i], prefix[i] = int(steps[cross]), prefix[i] * BINS + cross
            # boundaries between texts first; through a group of equal texts only beyond the slack
            open_[i] = best[i][0] > (slack if digit == DIGITS - 2 else near)
        if not any(open_):
            break
    return [place for _, place in best]


def assign(pts: DataFrame, shards: int, whole_group: float = 0.02) -> DataFrame:
    """``pts`` with ``shard``, 0 to shards - 1."""
    dims = [c for c in pts.columns if c[0] == "c" and c[1:].isdigit()]
    total, largest = pts.agg(F.sum("size"), F.max("size")).first()
    pts = pts.withColumn("node", F.lit(0))
    if total is None:
        return pts.withColumnRenamed("node", "shard")
    slack = max(whole_group * total / shards, largest) / 2
    near = total / shards / 1000
    gives = [shards]  # shards of each node, from left to right
    while max(gives) > 1:
        spans = {r["node"]: r for r in pts.groupBy("node").agg(
            *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        widest = []
        for n in range(len(gives)):
            ranges = [(spans[n][f"lo_{d}"], spans[n][f"hi_{d}"]) if n in spans else (0.0, 0.0) for d in dims]
            d = max(range(len(dims)), key=lambda i: (ranges[i][1] - ranges[i][0], -i))
            widest.append((d, *ranges[d]))
        pts = pts.withColumn("place", _place(dims, widest))
        cuts = _cuts(pts, gives, slack, near)
        left, right, grown = [], [], []
        for k in gives:
            left.append(len(grown))
            right.append(len(grown) + (k > 1))
            grown += [k // 2, k - k // 2] if k > 1 else [1]
        is_left = F.col("place") < _per_node([c if k > 1 else 1 << 60 for c, k in zip(cuts, gives)], "bigint")
        pts = pts.withColumn("node", F.when(is_left, _per_node(left, "int")).otherwise(_per_node(right, "int"))).drop("place")
        pts = cut_lineage(pts)  # narrow rows; six nested levels would not compile as one expression
        gives = grown
    return pts.withColumnRenamed("node", "shard")


def shard(docs: DataFrame, shards: int = 40, dims=("lang", "source"), id_col: str = "doc_id", text: str = "text",
          whole_group: float = 0.02) -> DataFrame:
    """doc_id, size, text_crc32, shard and a gapless slot from 0 in each shard (by row hash)."""
    pts = points(docs, [d for d in dims if d in docs.columns], id_col, text)
    placed = assign(pts, shards, whole_group).select("doc_id", "size", "text_crc32", "row_h", "shard")
    return global_rank(placed, [F.col("doc_id").asc_nulls_first(), "row_h"], "slot", base=0, partition_by=["shard"]) \
        .select("doc_id", "size", "text_crc32", "shard", "slot")


def for_target(docs: DataFrame, target_bytes: int, **options) -> DataFrame:
    """As many shards as keep each at about ``target_bytes``."""
    text = text_of(options.get("text", "text"))
    total = docs.agg(F.sum(F.octet_length(text) + ROW_BYTES)).first()[0] or 0
    return shard(docs, max(1, -(-total // target_bytes)), **options)
