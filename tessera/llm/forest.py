"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

Each different text has ``trees`` labels, sequences of MinHash values of its word shingles.
Texts meet where they share a label's prefix.  The prefix is shortened from ``max_depth`` on
until the chance that a pair at the threshold shares one in some tree reaches ``recall``: one
length for the whole corpus (longer matches are among the shorter ones), so labels are joined
by equality and no trie is built.  Texts that meet, directly or through others, form a candidate group; inside it every pair is compared exactly, by
its shingle sets.  A group of more than ``block`` texts is compared block against block,
so no task holds more than two blocks; only counts and stars leave a task, never pairs.

Result: one row per document with ``class_id`` (smallest doc_id among the texts linked
with it, directly or through others, and their copies), ``copy_id`` (smallest doc_id with an equal text),
``n_copies`` and ``n_links`` (different other texts with Jaccard >= threshold).

Defined cases: a null text is empty; equal texts are one text, empty ones too; a text of
one to four words is a single shingle of them all, one without words has none and no
links; a text is known by its hash (128 bits), never by its doc_id, so texts that share an id, or
have none, are linked by their words only (a null doc_id is the smallest); repeated rows give
repeated rows; long texts are read whole; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import binary, text_of
from tessera.llm.graph import components
from tessera.llm.shingles import SHINGLE, chunks, shingle_sets, signatures
from tessera.session import cut_lineage

THRESHOLD, TREES, MAX_DEPTH, RECALL, BLOCK = 0.8, 18, 8, 0.9999, 256
#: A table of at most this many (id, group) rows, about 64 MB, is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
_NO_ID = -(1 << 63)


def depth_for(threshold: float, trees: int, max_depth: int, recall: float) -> int:
    """The longest prefix that reaches the recall for a pair at the threshold."""
    for depth in range(max_depth, 0, -1):
        if 1 - (1 - threshold ** depth) ** trees >= recall:
            return depth
    raise ValueError(f"{trees} trees cannot reach a recall of {recall}")


def _sketch(trees: int, max_depth: int, depth: int, n: int):
    def run(batches):
        for batch in batches:
            ids, texts, h = batch.column(0), binary(batch.column(1)), batch.column(2)
            for lo, hi in chunks(texts):
                g, at = shingle_sets(texts[lo:hi], n)
                sig = signatures(g, at, trees * max_depth).reshape(hi - lo, trees, max_depth)[:, :, :depth]
                label = np.zeros((hi - lo, trees), np.uint64)
                for k in range(depth):
                    label = label * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k]
                label = label.view(np.int64)
                labels = [row if m else [] for row, m in zip(label.tolist(), np.diff(at).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), h.slice(lo, hi - lo), pa.array(labels, pa.list_(pa.int64()))], ["id", "h", "labels"])
    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            texts = binary(batch.column(3))
            for lo, hi in chunks(texts):
                g, at = shingle_sets(texts[lo:hi], n)
                data = [g[a:b].tobytes() for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in range(3)), pa.array(data, pa.binary())],
                                                 ["node", "grp", "blocks", "shingles"])
    return run


def shared_counts(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """(sets, sets) sizes of the intersections, by products of 0/1 blocks of ``width`` shingles."""
    n = len(sets)
    out = np.zeros((n, n), np.float32 if max((len(s) for s in sets), default=0) < 1 << 24 else np.float64)
    values, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    number = np.cumsum(count > 1) - 1  # shingles of one set only meet nothing
    many = count[col] > 1
    row, col = row[many], number[col[many]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((n, width), out.dtype)
        m[row[a:b], col[a:b] - lo] = 1
        out += m @ m.T
    sizes = np.array([len(s) for s in sets])
    out[np.arange(n), np.arange(n)] = sizes
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index linked with each index, by pairs a, b."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _verify(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable").reset_index(drop=True)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        both, sizes = shared_counts(sets), np.array([len(s) for s in sets], float)
        linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6
        one, other = int(pdf["x"][0]), int(pdf["y"][0])
        mine = pdf["own"].to_numpy()
        if one != other:  # pairs inside a block are counted where it meets itself
            linked &= mine[:, None] != mine[None, :]
        np.fill_diagonal(linked, False)
        a, b = np.nonzero(np.triu(linked))
        root = _roots(len(sets), a, b)
        nodes = pdf["node"].to_numpy()
        return pd.DataFrame({"node": nodes, "root": nodes[root], "n_links": linked.sum(axis=1)})
    return run


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, trees: int = TREES, max_depth: int = MAX_DEPTH,
            recall: float = RECALL, block: int = BLOCK, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, copy_id, n_copies, n_links, the text's hash ``h``, and whether the text leads its class
    (that of the smallest doc_id; of several texts under it, of the smallest hash)."""
    depth = depth_for(threshold, trees, max_depth, recall)
    rows = _rows(docs, id_col, text)
    sketch = cut_lineage(rows.mapInArrow(_sketch(trees, depth, depth, n), "id bigint, h binary, labels array<bigint>"))
    texts = sketch.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("labels").alias("labels"))
    texts = cut_lineage(texts.withColumn("node", F.monotonically_increasing_id()))
    # where two texts share a prefix, each is tied to the bucket's first
    at = texts.select(F.col("node").alias("u"), F.posexplode("labels").alias("tree", "label"))
    first = at.groupBy("tree", "label").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = components(at.join(first, ["tree", "label"]).select("u", "v"))
    met = met.select(F.col("u").alias("node"), F.col("v").alias("grp")).unionByName(met.select(F.col("v").alias("node"), F.col("v").alias("grp")).distinct())
    sizes = met.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    met = met.join(sizes, "grp").select("node", "grp", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    members = cut_lineage(met.join(texts.select("node", "rep", "h"), "node"))
    if members.count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    # one row of each text: that of its smallest id
    held = rows.join(members, (rows["id"] == members["rep"]) & (rows["h"] == members["h"])).select("node", "grp", "blocks", "text").mapInArrow(
        _sets(n), "node bigint, grp bigint, blocks int, shingles binary").dropDuplicates(["node"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    units = held.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("node", "grp", "own", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "shingles")
    found = cut_lineage(units.groupBy("grp", "x", "y").applyInPandas(_verify(threshold), "node bigint, root bigint, n_links bigint"))
    links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    root = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    linked = texts.select("node", "h", "rep", "n_copies").join(links, "node", "left") \
        .join(root, F.col("node") == F.col("u"), "left").withColumn("root", F.coalesce("v", "node"))
    lead = linked.groupBy("root").agg(F.min(F.struct("rep", "h")).alias("lead"))
    per_text = linked.join(lead, "root").select(
        "h", F.col("rep").alias("copy_id"), "n_copies", F.col("lead.rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.col("h") == F.col("lead.h")).alias("leads"))
    shown = lambda c: F.nullif(F.col(c), F.lit(_NO_ID)).alias(c)
    return sketch.select(F.col("id").alias("doc_id"), "h").join(per_text, "h") \
        .select(*[shown(c) for c in ("doc_id", "class_id", "copy_id")], "n_copies", "n_links", "h", "leads")


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("id"), text_of(text).alias("text"),
                       F.unhex(F.md5(text_of(text))).alias("h"))


def keep(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class, with its own columns: of the text that leads it the row with the smallest id
    (of rows that repeat it, one)."""
    found = classes(docs, id_col=id_col, text=text, **options)
    stay = cut_lineage(found.filter(F.col("leads") & F.col("doc_id").eqNullSafe(F.col("copy_id"))).select(F.col("doc_id").alias("stay"), F.col("h").alias("stay_h")).distinct())
    tagged = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("d"), F.unhex(F.md5(text_of(text))).alias("h"), F.xxhash64("*").alias("x"))
    joined = tagged.join(stay, (F.col("h") == F.col("stay_h")) & F.col("d").eqNullSafe(F.col("stay")))
    return joined.groupBy("h").agg(F.min_by("row", "x").alias("row")).select("row.*")
