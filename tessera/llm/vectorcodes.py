"""Compression of vectors to short codes: product codebooks by dual-tree Lloyd.

Components become integers (floor of ``scale`` x), so every distance, bound, sum and mean is
exact and no result depends on how rows are dealt out.  A vector is cut into ``parts`` equal
parts; each part position has a codebook of ``entries`` vectors, which starts as that part of
the rows with the smallest ids.

1. Rows are gathered in blocks of ``block_rows``.  For each part position a block holds a
   balanced tree over its parts: every node is a range of the tree's order with its bounding
   box and its componentwise sum.  Blocks are written once to the shared folder.
2. In a round the codebook, a small tree of its different entries too, goes to all tasks.  Pairs
   of a part node and an entry node are bounded by their boxes: an entry node that is farther
   than another one can be is dropped, single entries also by the bisector with the nearest one.
   A node with one entry left is assigned whole, by its cached sum; only what stays uncertain in
   a leaf is compared part by part.  A task sends its sums once, entries x parts x components.
3. The driver gets the total sums, as many numbers as the codebook has, and divides.

Defined cases: a null vector, or one with a null, NaN or infinite component, is dropped; vectors
of another length than the most frequent one that parts divide (ties: the longest) stay with a
null code and error; with fewer rows than entries the codebook is as small; rows with equal ids
are ordered by their vectors, a null id comes last; equal entries are one to the tree, and the
lowest index wins; an entry without parts stays as it is; repeated rows get equal codes; other
columns are ignored; an empty table gives an empty result.  Components up to 2**100 are exact; an
error that a long cannot hold is the largest long.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.session import cut_lineage

SCALE, PARTS, ENTRIES, ROUNDS, BLOCK_ROWS, LEAF = 4096, 8, 16, 6, 16384, 32
_LIMB, _LONG = 1 << 60, (1 << 63) - 1


class PartTree:
    """Balanced tree over the rows of ``x``: level L has 2**L nodes, node i is rows i*n >> L .. (i+1)*n >> L of ``order``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        n = len(x)
        self.depth = max(0, (max(n, 1) // leaf).bit_length() - 1)
        order, node = np.arange(n), np.zeros(n, np.int64)
        for level in range(self.depth):
            starts = self.starts(n, level)
            spread = np.maximum.reduceat(x[order], starts) - np.minimum.reduceat(x[order], starts)
            widest = spread.argmax(axis=1)
            order = order[np.lexsort((x[order, widest[node]], node))]
            node = np.repeat(np.arange(2 << level), np.diff(np.append(self.starts(n, level + 1), n)))
        self.order, self.x = order.astype(np.int32), x[order]
        starts = self.starts(n, self.depth)
        low, high = np.minimum.reduceat(self.x, starts), np.maximum.reduceat(self.x, starts)
        total = np.add.reduceat(self.x.astype(np.int64) if self.x.dtype != np.float64 else self.x, starts)
        self.levels = [(low, high, total)]
        for _ in range(self.depth):
            low, high, total = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), total[::2] + total[1::2]
            self.levels.insert(0, (low, high, total))

    @staticmethod
    def starts(n: int, level: int) -> np.ndarray:
        return (np.arange(1 << level) * n) >> level


class EntryTree:
    """Tree of a codebook's different entries: boxes, children and, for a leaf, the entry's index."""

    def __init__(self, entries: np.ndarray):
        different: dict = {}
        for i, e in enumerate(entries.tolist()):
            different.setdefault(tuple(e), i)
        self.low, self.high, self.children, self.entry = [], [], [], []
        self._grow(entries, np.array(sorted(different.values())))
        self.low, self.high = np.array(self.low, entries.dtype), np.array(self.high, entries.dtype)
        self.children, self.entry = np.array(self.children), np.array(self.entry)

    def _grow(self, entries: np.ndarray, own: np.ndarray) -> int:
        at, x = len(self.entry), entries[own]
        self.low.append(x.min(axis=0))
        self.high.append(x.max(axis=0))
        self.children.append((-1, -1))
        self.entry.append(int(own[0]) if len(own) == 1 else -1)
        if len(own) > 1:
            own = own[np.argsort(x[:, (x.max(axis=0) - x.min(axis=0)).argmax()], kind="stable")]
            half = len(own) // 2
            self.children[at] = (self._grow(entries, own[:half]), self._grow(entries, own[half:]))
        return at


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)


def _prune(p, e, low, high, tree: EntryTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (part node, entry node), sorted by part node, that the bounds cannot rule out."""
    lo, hi = low[p], high[p]
    gap = np.maximum(np.maximum(tree.low[e] - hi, lo - tree.high[e]), 0)
    reach = np.maximum(tree.high[e] - lo, hi - tree.low[e])
    first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    size = np.diff(np.append(first, len(p)))
    keep = _squares(gap) <= np.repeat(np.minimum.reduceat(_squares(reach), first), size)
    p, e = p[keep], e[keep]
    # single entries against the one nearest to the middle of the node's box
    first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    size = np.diff(np.append(first, len(p)))
    single = tree.entry[e] >= 0
    c = entries[tree.entry[e]]
    lo, hi = low[p], high[p]
    off = _squares(lo + hi - 2 * c)
    group = np.repeat(np.arange(len(first)), size)
    rank = np.lexsort((tree.entry[e], off, ~single, group))[first]  # the best of each part node
    best, known = np.repeat(rank, size), np.repeat(single[rank], size)
    b = entries[tree.entry[e[best]]]
    slope = b - c
    # the largest value of |x - b|^2 - |x - c|^2 over the box
    most = (b * b - c * c - 2 * slope * np.where(slope > 0, lo, hi)).sum(axis=1)
    worse = known & single & (best != np.arange(len(e))) & ((most < 0) | ((most == 0) & (tree.entry[e[best]] < tree.entry[e])))
    return p[~worse.astype(bool)], e[~worse.astype(bool)]


def assign(tree: PartTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entry of each row in the tree's order, rows and sums of each entry, and how many rows
    were compared one by one.  ``entries`` has the type of exact numbers: int64, or Python integers."""
    kind, n = entries.dtype, len(tree.x)
    code, count = np.zeros(n, np.int64), np.zeros(len(entries), np.int64)
    sums = np.zeros(entries.shape, kind)
    near = EntryTree(entries)
    p, e, compared = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
    for level in range(tree.depth + 1):
        low, high, total = (_exact(a, kind) for a in tree.levels[level])
        bounds = np.append(PartTree.starts(n, level), n)
        while True:
            p, e = _prune(p, e, low, high, near, entries)
            inner = near.entry[e] < 0
            if not inner.any():
                break
            p, e = np.repeat(p, 1 + inner), np.stack([np.where(inner, near.children[e, 0], e), near.children[e, 1]], 1) \
                .reshape(-1)[np.stack([np.ones(len(e), bool), inner], 1).reshape(-1)]
            if level < tree.depth:
                p, e = _prune(p, e, low, high, near, entries)
                break
        first = np.append(True, p[1:] != p[:-1])
        lone = first & np.append(first[1:], True) & (near.entry[e] >= 0)
        node, entry = p[lone], near.entry[e[lone]]
        size = bounds[node + 1] - bounds[node]
        np.add.at(count, entry, size)
        np.add.at(sums, entry, total[node])
        code[_ranges(bounds[node], size)] = np.repeat(entry, size)
        p, e = p[~lone], e[~lone]
        if not len(p):
            break
        if level < tree.depth:
            p, e = np.repeat(2 * p, 2) + np.tile([0, 1], len(p)), np.repeat(e, 2)
            order = np.argsort(p, kind="stable")
            p, e = p[order], e[order]
            continue
        node, of = np.unique(p, return_inverse=True)
        possible = np.zeros((len(node), len(entries)), bool)
        possible[of, near.entry[e]] = True
        size = bounds[node + 1] - bounds[node]
        rows = _ranges(bounds[node], size)
        away = _squares(entries) - 2 * (_exact(tree.x[rows], kind) @ entries.T)  # less |x|^2, equal for all entries
        entry = np.where(np.repeat(possible, size, axis=0), away, away.max() + 1).argmin(axis=1)
        code[rows], compared = entry, len(rows)
        np.add.at(count, entry, 1)
        np.add.at(sums, entry, _exact(tree.x[rows], kind))
    return code, count, sums, compared


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _exact(a: np.ndarray, kind) -> np.ndarray:
    if kind != object:
        return a.astype(np.int64)
    return np.array([int(v) for v in a.reshape(-1).tolist()], object).reshape(a.shape)


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(x * scale)
    return x.astype(np.int32) if not x.size or np.abs(x).max() < 1 << 24 else x


def _kind(largest: float, width: int):
    """Type in which all squared distances are exact."""
    return np.dtype(np.int64) if 32.0 * largest * largest * width < 1 << 62 else np.dtype(object)


def _blocks(parts: int, scale: int, block_rows: int):
    """Rows (id, label, vector) to blocks: ids, labels, and the trees of each part position."""
    def run(batches):
        held: list = []

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            x = _integers(rows.column(2).chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1), scale)
            trees = [PartTree(part) for part in np.split(x, parts, axis=1)]
            if x.dtype == np.float64:  # sums beyond a long are taken from the numbers themselves
                for t in trees:
                    _sum_exactly(t)
            wrap = lambda c: pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), c.chunk(0))
            return pa.RecordBatch.from_arrays([wrap(rows.column(0)), wrap(rows.column(1)), pa.array([pickle.dumps(trees)], pa.binary()),
                                               pa.array([float(np.abs(x).max())])], ["ids", "labels", "trees", "largest"])

        n = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block_rows - n)
                held.append(part)
                n, batch = n + part.num_rows, batch.slice(part.num_rows)
                if n == block_rows:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()
    return run


def _sum_exactly(tree: PartTree) -> None:
    x = _exact(tree.x, np.dtype(object))
    for level, (low, high, _) in enumerate(tree.levels):
        tree.levels[level] = (low, high, np.add.reduceat(x, PartTree.starts(len(x), level)))


def _totals(codebook):
    """Blocks to one set of rows (part, entry, component, hi, lo) for the task: sums, and rows as component -1."""
    def run(batches):
        books, total = codebook.value, None
        for batch in batches:
            for blob in batch.column(2):
                for j, tree in enumerate(pickle.loads(blob.as_buffer())):
                    _, count, sums, _ = assign(tree, books[j])
                    if total is None:
                        total = [np.zeros((len(b), b.shape[1] + 1), object) for b in books]
                    total[j] += np.column_stack([count.astype(object), sums.astype(object)])
        if total is not None:
            rows = [(j, i, k - 1, v // _LIMB, v % _LIMB) for j, t in enumerate(total) for i, row in enumerate(t.tolist()) for k, v in enumerate(row) if v]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols[:3]] + [pa.array(cols[3], pa.decimal128(38, 0)), pa.array(cols[4], pa.int64())],
                                             ["part", "entry", "component", "hi", "lo"])
    return run


def _codes(codebook):
    def run(batches):
        books = codebook.value
        for batch in batches:
            for k in range(batch.num_rows):
                trees = pickle.loads(batch.column(2)[k].as_buffer())
                n = len(trees[0].order)
                codes, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, books[0].dtype)
                for j, (tree, book) in enumerate(zip(trees, books)):
                    code = assign(tree, book)[0]
                    codes[tree.order, j] = code
                    error[tree.order] += _squares(_exact(tree.x, book.dtype) - book[code])
                text, w = codes.tobytes().hex(), 2 * len(books)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[k].values, batch.column(1)[k].values, pa.array([text[i:i + w] for i in range(0, w * n, w)]),
                     pa.array([min(int(v), _LONG) for v in error.tolist()], pa.int64())], ["id", "label", "code", "error"])
    return run


def _updated(books: list[np.ndarray], rows: list) -> list[np.ndarray]:
    total: dict = {}
    for r in rows:
        total[r["part"], r["entry"], r["component"]] = int(r["hi"]) * _LIMB + int(r["lo"])
    out = []
    for j, book in enumerate(books):
        new = book.copy()
        for i in range(len(book)):
            n = total.get((j, i, -1), 0)
            if n:
                new[i] = [total.get((j, i, k), 0) // n for k in range(book.shape[1])]
        out.append(new)
    return out


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def fit(blocks: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds over the written blocks."""
    sc = blocks.sparkSession.sparkContext
    for _ in range(rounds):
        sent = sc.broadcast(books)  # entries x width numbers
        sums = blocks.mapInArrow(_totals(sent), "part int, entry int, component int, hi decimal(38,0), lo bigint")
        sums = sums.groupBy("part", "entry", "component").agg(F.sum("hi").alias("hi"), F.sum(F.col("lo").cast("decimal(38,0)")).alias("lo"))
        books = _updated(books, sums.collect())  # entries x (width + parts) rows at most
        sent.unpersist()
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every row whose vector is whole."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    width = rows.filter((F.size("v") > 0) & (F.size("v") % parts == 0)).groupBy(F.size("v").alias("w")).count() \
        .orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    width = width[0]["w"] if width else -1
    fits = F.size("v") == width
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"
    if width < 0:
        out, books = spark.createDataFrame([], schema), []
    else:
        blocks = written(rows.filter(fits).mapInArrow(_blocks(parts, scale, block_rows),
                                                      f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, trees binary, largest double"), "vectors")
        first = rows.filter(fits).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
        kind = _kind(blocks.agg(F.max("largest")).first()[0], width)
        start = _exact(np.floor(np.array([r["v"] for r in first]) * scale), kind)
        books = fit(blocks, np.split(start, parts, axis=1), rounds)
        out = blocks.mapInArrow(_codes(spark.sparkContext.broadcast(books)), schema)
    rest = rows.filter(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    out = cut_lineage(out.unionByName(rest))
    sums = out.groupBy(F.col("label").alias("l")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG)).cast("bigint").alias("label_error"))
    return out.join(sums, F.col("label").eqNullSafe(F.col("l"))).select(
        F.col("id").alias("vec_id"), "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    steps = [f"""k as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
             f"""p as materialized (select vec_id, label, r.part, v[r.part * (len(v) // {parts}) + 1 : (r.part + 1) * (len(v) // {parts})] x
    from k, range({parts}) r(part))""",
             f"""c0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 entry, x from p
    qualify row_number() over (partition by part order by vec_id) <= {entries})"""]
    near = """a{r} as materialized (select p.vec_id, p.part, min(list_sum(list_transform(list_zip(p.x, c{r}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint
    * {entries} + c{r}.entry) m from p join c{r} using (part) group by p.vec_id, p.part)"""
    for r in range(rounds):
        steps.append(near.format(r=r, entries=entries))
        steps.append(f"""s{r} as (select part, m % {entries} entry, i, sum(x[i])::bigint s, count(*) n from a{r} join p using (vec_id, part),
    range(1, (select max(len(x)) + 1 from p)) g(i) group by all)""")
        steps.append(f"""c{r + 1} as materialized (select c.part, c.entry, coalesce(f.x, c.x) x from c{r} c left join
    (select part, entry, list(((s - (s % n + n) % n) / n)::bigint order by i) x from s{r} group by part, entry) f using (part, entry))""")
    steps.append(near.format(r=rounds, entries=entries))
    steps.append(f"""d as (select vec_id, string_agg(printf('%02x', (m % {entries})::int), '' order by part) code, sum(m // {entries})::bigint error from a{rounds} group by vec_id)""")
    steps.append(f"""h as (select sha256(string_agg(v::varchar, ',' order by part, entry, i)) codebooks_sha256 from
    (select part, entry, unnest(x) v, generate_subscripts(x, 1) i from c{rounds}))""")
    return "with " + ",\n".join(steps) + """
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, codebooks_sha256 from d join k using (vec_id), h"""


OP12_SQL = _sql()
