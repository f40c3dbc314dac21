"""Filter interaction audit: truth-table survival words and positional popcounts.

Five filters fail a document or not: A few words, B few different words, C many capitals, D one
of some symbols, E a copy of an earlier document's text.  What a set of filters leaves of a
corpus follows from one 32-bit word a document: bit S is set if the document survives the
subset S of filters.  Tasks add up their words by part and label with carry-save adders: three
words of one weight become one of that weight and one of twice the weight, until a few words of
each weight are left, whose bits are counted.  The 32 sums of a part are its survivors of every
subset, and from them follow all 120 orders: what a step keeps and removes is the difference of
two subsets, and so are its redundant and unique failures, the good and toxic documents it loses
and the Shapley value.

Filter E needs the smallest doc_id of each text, by a hash of 128 bits: one table of the texts
that stand in several rows is joined back.  It and the labels are written tables before they are
joined, so that Spark can split a hot text or id over many tasks.

Defined cases: a null text is empty; a null part is the empty string; a null doc_id is the
smallest and has no label; rows under one doc_id are no copies of each other; several labels of
a document count as one that says 1 if any does; a text without words fails A alone (0 is not
under 0); long texts are read whole; other columns are ignored; an empty table gives an empty
result; parts come from the table, so a part without rows has none in the result.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import binary, text_of
from tessera.session import cut_lineage

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SYMBOLS = 200, 50, 2, b"#$%&*|"
_SUBSETS, _COPY = 1 << len(FILTERS), 1 << FILTERS.index("E")
_UPPER, _INNER = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
_HOLD = 1 << 20
#: By the set of filters a document fails: bit S is set if no filter of the subset S is among them.
WORDS = np.array([sum(1 << s for s in range(_SUBSETS) if not fails & s) for fails in range(_SUBSETS)], np.uint32)


def own_failures(text: bytes, min_words: int = MIN_WORDS, distinct_percent: int = MIN_DISTINCT_PERCENT,
                 capitals_percent: int = MAX_CAPITALS_PERCENT, symbols: bytes = SYMBOLS) -> int:
    """The filters A to D that a text fails, as bits."""
    words = text.split()  # on ASCII white space
    capitals = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _INNER))  # bytes that begin a code point
    return (len(words) < min_words) | (100 * len(set(words)) < distinct_percent * len(words)) << 1 \
        | (100 * capitals > capitals_percent * points) << 2 | (len(text.translate(None, symbols)) < len(text)) << 3


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many words have each of the 32 bits, by carry-save adders."""
    counts, lanes, weight = np.zeros(32, np.int64), words, 1
    while len(lanes):
        carries = []
        while len(lanes) > 2:
            third = len(lanes) // 3
            a, b, c, rest = lanes[:third], lanes[third:2 * third], lanes[2 * third:3 * third], lanes[3 * third:]
            half = a ^ b
            carries.append((a & b) | (half & c))
            lanes = np.concatenate([half ^ c, rest])
        for w in lanes.tolist():
            counts += weight * ((w >> np.arange(32)) & 1)
        lanes, weight = (np.concatenate(carries) if carries else lanes[:0]), 2 * weight
    return counts


def _facts(options: dict):
    def run(batches):
        for batch in batches:
            texts = binary(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([own_failures(t, **options) for t in texts], pa.int32()),
                 pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())], ["id", "part", "fails", "h"])
    return run


def _counts(batches):
    """Rows (part, label, fails) to rows (part, label, subset, n), summed in the task."""
    held, n = [], 0

    def flush():
        rows = pa.Table.from_batches(held).combine_chunks()
        names = rows.column(0).combine_chunks().dictionary_encode()
        group = names.indices.to_numpy().astype(np.int64) * 4 + rows.column(1).to_numpy()
        words = WORDS[rows.column(2).to_numpy()]
        order = np.argsort(group, kind="stable")
        group, words = group[order], words[order]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        counts = np.stack([positional_popcount(w) for w in np.split(words, first[1:])])
        at, subset = np.nonzero(counts)
        own = group[first][at]
        return pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(own // 4)), pa.array((own % 4).astype(np.int32)),
                                           pa.array(subset.astype(np.int32)), pa.array(counts[at, subset])], ["part", "label", "subset", "n"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= _HOLD:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _steps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By order and step: the filter, and the subsets before and after it."""
    which = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    after = np.bitwise_or.accumulate(1 << which, axis=1)
    return which, after ^ (1 << which), after


def _report(batches):
    which, before, after = _steps()
    size = which.size
    for batch in batches:
        for part, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n, good, toxic = np.zeros((3, _SUBSETS), np.int64)
            for r in rows:
                n[r["subset"]], good[r["subset"]], toxic[r["subset"]] = r["n"], r["good"], r["toxic"]
            removed = n[before] - n[after]
            total = np.zeros(len(FILTERS), np.int64)
            np.add.at(total, which, removed)
            lose = n[0] - n[1 << which]
            cols = [n[after], removed, lose - removed, n[(_SUBSETS - 1) ^ (1 << which)] - n[_SUBSETS - 1],
                    good[before] - good[after], toxic[before] - toxic[after], total[which]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * size), pa.array(np.repeat(ORDERS, len(FILTERS)).tolist()), pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))),
                 *[pa.array(c.reshape(-1)) for c in cols]], _COLUMNS)


_COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source", **options) -> DataFrame:
    """id, part and the filters each document fails, as bits (A is 1, E is 16)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of(text).alias("text"))
    facts = cut_lineage(rows.mapInArrow(_facts(options), "id bigint, part string, fails int, h binary"))
    lowest = F.coalesce("id", F.lit(-(1 << 63)))
    first = cut_lineage(facts.groupBy(F.col("h").alias("t")).agg(F.min(lowest).alias("first"), F.count(F.lit(1)).alias("rows"))
                        .filter("rows > 1").select("t", "first"))
    copy = F.when(lowest > F.col("first"), _COPY).otherwise(0)
    return facts.join(first, F.col("h") == F.col("t"), "left").select("id", "part", F.col("fails").bitwiseOR(copy).alias("fails"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source",
          label_id: str = "doc_id", good: str = "quality", toxic: str = "toxic", **options) -> DataFrame:
    """One row per part, order of the filters and step."""
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = cut_lineage(labels.filter(F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("bigint").alias("l"))
                        .agg((is_one(good) + 2 * is_one(toxic)).alias("label")).filter("label > 0"))
    words = failures(docs, id_col, text, part, **options).join(marks, F.col("id") == F.col("l"), "left") \
        .select("part", F.coalesce("label", F.lit(0)).alias("label"), "fails")
    counts = words.mapInArrow(_counts, "part string, label int, subset int, n bigint")
    of = lambda bit: F.coalesce(F.sum(F.when(F.col("label").bitwiseAND(bit) > 0, F.col("n"))), F.lit(0))
    sums = counts.groupBy("part", "subset").agg(F.sum("n").alias("n"), of(1).alias("good"), of(2).alias("toxic"))
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("subset", "n", "good", "toxic")).alias("rows"))  # 32 at most
    return parts.mapInArrow(_report, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in _COLUMNS[3:]))


OP11_SQL = r"""
with f as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
m as (select doc_id, part, ((len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * (doc_id > min(doc_id) over (partition by t))::int) fails from f),
l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
g as (select part, fails, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from m left join l using (doc_id) group by all),
x as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, b)),
o as (select a.c || b.c || d.c || e.c || f.c filter_order from x a, x b, x d, x e, x f where a.b | b.b | d.b | e.b | f.b = 31),
s as (select filter_order, step::int step, x.b bit, (select sum(y.b)::int from x y where contains(left(filter_order, step - 1), y.c)) before
    from o, range(1, 6) r(step), x where x.c = filter_order[step]),
u as (select filter_order, step, bit, coalesce(before, 0) b from s),
q as (select part, filter_order, step, bit, coalesce(sum(n) filter (fails & (b | bit) = 0), 0)::bigint kept,
    coalesce(sum(n) filter (fails & b = 0 and fails & bit > 0), 0)::bigint removed, coalesce(sum(n) filter (fails & b > 0 and fails & bit > 0), 0)::bigint redundant,
    coalesce(sum(n) filter (fails = bit), 0)::bigint unique_fails, coalesce(sum(good) filter (fails & b = 0 and fails & bit > 0), 0)::bigint good_lost,
    coalesce(sum(toxic) filter (fails & b = 0 and fails & bit > 0), 0)::bigint toxic_lost from g, u group by part, filter_order, step, bit)
select * exclude (bit), sum(removed) over (partition by part, bit)::bigint shapley from q
"""
