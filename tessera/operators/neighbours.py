"""k-nearest-neighbour mutual information of continuous features with a continuous target.

The estimator of Kraskov, Stoegbauer and Grassberger (2004), as a selector of features uses it:
both variables are divided by their population standard deviation, d is a point's distance to
its k-th neighbour under the maximum norm, and n_x, n_y count the points, itself included, that
are closer than d in one variable alone (at distance 0 if d is 0):

    mi = psi(n) + psi(k) - mean(psi(n_x) + psi(n_y)), at least 0.

1. Equal points of a feature are one row with a weight.
2. The points of a feature, in the order of (x, y), are cut into strips of about ``cell_points``,
   more where a feature has very many.  A strip is written as one row with its sorted points, its
   box and its sums.  Where the cuts fall changes the work of a task, never a result.
3. A strip finds the neighbours of its own points in a tree of boxes.  Only a point whose
   k-th neighbour there is farther than another strip's box goes to that strip as well.
4. n_x of a point whose interval ends inside its strip is counted there; for n_y the points are
   dealt once more, in the order of (y, x), to blocks of about ``block_values``.  The ends of the other
   intervals are looked up in the strips or blocks that hold them.

Strips and blocks that get more than ``chunk`` look-ups are served by several tasks.  Sums are exact until a standard
deviation is rounded, so its last bit, which equal distances hang on, does not depend on the order of the rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.stats import digamma_int
from tessera.session import cut_lineage, ship_package

CELL_POINTS, BLOCK_VALUES, CHUNK = 1 << 16, 1 << 16, 1 << 16
_LEAF = 16
_PAIRS = 1 << 19      # distances held at once
_SUMS = "n long, sums array<double>, squares array<double>"
_BOX = ("low_x", "high_x", "low_y", "high_y")


def mutual_info_knn_target(cells: DataFrame, target: DataFrame, key: str, feature: str, value: str, y: str, k: int = 3,
                           cell_points: int = CELL_POINTS, block_values: int = BLOCK_VALUES, chunk: int = CHUNK) -> DataFrame:
    """(feature, mi).  NULL and NaN values and targets are left out; a feature with one row has
    no neighbours and gets 0; with fewer than k + 1 rows k is what there is; a constant
    variable keeps its scale; ties are counted as they are, without jitter."""
    ship_package(cells.sparkSession)
    points, unit = _points(cells, target, key, feature, value, y)
    f = f"f {points.schema['f'].dataType.simpleString()}"
    strips, blocks = _bounds(points, "x", "y", cell_points), _bounds(points, "y", "x", block_values)
    packs = cut_lineage(_placed(points, strips, "x", "y").groupBy("f", "part").applyInArrow(
        _pack, f"{f}, part int, {_SUMS}, {', '.join(f'{c} double' for c in _BOX)}, xs binary, ys binary, ws binary"))
    sizes = cut_lineage(_sizes(packs, k))
    packed = packs.select("f", "part", "xs", "ys", "ws").join(sizes.filter("n > 1"), "f")
    found = cut_lineage(packed.groupBy("f", "part").applyInArrow(
        _nearest(unit), f"{f}, part int, i int, x double, y double, w long, d double, near array<double>, meets array<int>, open_x boolean, m array<long>, c array<long>"))
    heads = [found.filter("i is null").select("f", "m", "c")]
    columns = ["f", "part", "i", "x", "y", "w", "d", "open_x"]
    at = found.filter("i is not null").select(*columns)
    counts = []
    if strips is not None:
        asking = found.filter("size(meets) > 0")
        at = found.filter("i is not null and size(meets) = 0").select(*columns).unionByName(cut_lineage(_across(asking, packs, sizes, unit, chunk, f)))
        scaled = sizes.select("f", F.col("s").alias("scale"))
        probes = at.filter("open_x").join(scaled, "f").select("f", "part", "i", "w", (F.col("x") / F.col("scale")).alias("v"), "d")
        counts.append(_look_up(probes, packs.select("f", "part", "n", F.col("low_x").alias("low"), F.col("xs").alias("vs"), "ws").join(scaled, "f"), chunk, f))
    placed = _placed(at.select("f", "x", "y", "w", "d"), blocks, "y", "x")
    counted = placed.groupBy("f", "part").applyInArrow(
        _count(unit, blocks is not None), f"{f}, part int, i int, v double, w long, d double, n long, low double, vs binary, ws binary, m array<long>, c array<long>")
    if blocks is not None:
        counted = cut_lineage(counted)
        held = counted.filter("i is null").select("f", "part", "n", "low", "vs", "ws", F.lit(unit).alias("scale"))
        counts.append(_look_up(counted.filter("i is not null").select("f", "part", "i", "w", "v", "d"), held, chunk, f))
    heads.append(counted.filter("i is null").select("f", "m", "c"))
    counts += [h.select("f", F.explode(F.arrays_zip("m", "c")).alias("q")).select("f", "q.m", F.col("q.c").alias("w")) for h in heads]
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    psi = every.groupBy("f").agg(F.sum(F.col("w") * digamma_int("m")).alias("psi"))
    return sizes.join(psi, "f", "left").select(
        F.col("f").alias(feature), F.when(F.col("n") < 2, 0.0).otherwise(
            F.greatest(F.lit(0.0), digamma_int("n") + digamma_int("k") - F.col("psi") / F.col("n"))).alias("mi"))


# ------------------------------------------------------------------ points and strips
def _points(cells: DataFrame, target: DataFrame, key: str, feature: str, value: str, y: str) -> tuple[DataFrame, float]:
    """(f, x, y, w): different points, written once; and the target's unit."""
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    known = target.filter(there(y)).select(key, F.col(y).cast("double").alias("y"))
    pieces = known.select("y", F.pmod(F.xxhash64("y"), F.lit(64)).cast("int").alias("part")).groupBy("part").applyInArrow(
        lambda t: pa.table({"part": t["part"][:1], **_sums(t["y"].to_numpy(), np.ones(len(t), np.int64))}), f"part int, {_SUMS}")
    unit = _merged(pieces, []).first()["s"] or 1.0                            # one number
    rows = cells.filter(there(value) & F.col(feature).isNotNull()).select(key, F.col(feature).alias("f"), F.col(value).cast("double").alias("x")).join(known, key)
    return cut_lineage(rows.groupBy("f", "x", "y").agg(F.count(F.lit(1)).alias("w"))), unit


def _merged(parts: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """(by, n, s, more): rows and standard deviation from the sums of parts."""
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("sums", "squares")]
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), *lists, *more).withColumn("s", F.udf(lambda n, sums, squares: _deviation(n, sums, squares), "double")("n", "sums", "squares")).drop("sums", "squares")


def _sums(x: np.ndarray, w: np.ndarray) -> dict:
    """Rows and, as numbers that add up to them without rounding, the sums of the values and of their squares."""
    with np.errstate(over="ignore", invalid="ignore"):
        square, rest = _product(x, x)
        times = w.astype(float)
        sums, squares = _product(x, times), _product(square, times) + _product(rest, times)
    return {"n": [int(w.sum())], **{c: pa.array([_exactly(v)], pa.list_(pa.float64())) for c, v in (("sums", sums), ("squares", squares))}}


def _product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded product and what rounding took from it."""
    halves = []
    for v in (a, b):
        high = v * 134217729.0
        high = high - (high - v)
        halves.append((high, v - high))
    (ah, al), (bh, bl) = halves
    p = a * b
    return p, al * bl - (((p - ah * bh) - al * bh) - ah * bl)


def _exactly(parts: tuple[np.ndarray, ...]) -> list[float]:
    """A few numbers whose sum is that of all the parts; NaN if it is not finite."""
    v, out = np.concatenate(parts), []
    if not np.isfinite(v).all():
        return [math.nan]
    v = v[v != 0].tolist()
    while rest := math.fsum(v):
        out.append(rest)
        v.append(-rest)
    return out


def _deviation(n: int | None, sums: list[float], squares: list[float]) -> float | None:
    """Population standard deviation, rounded once."""
    if not n:
        return None
    if not all(map(math.isfinite, sums + squares)):
        return math.nan
    total, square = (sum(map(Fraction, v), Fraction(0)) for v in (sums, squares))
    return math.sqrt(max(Fraction(0), n * square - total * total) / (n * n))


def _bounds(points: DataFrame, first: str, second: str, size: int) -> DataFrame | None:
    """(f, bounds): points, in the order of two columns, at which features of more than ``size`` points are cut; None if there
    are none.  The cuts are chosen among points picked by their hash, some 32 for each cut."""
    wanted = F.greatest(F.lit(float(size)), F.sqrt(F.col("points") * size / 16))
    large = cut_lineage(points.groupBy("f").agg(F.count(F.lit(1)).alias("points")).filter(F.col("points") > size)
                        .select("f", F.ceil(F.col("points") / wanted).cast("int").alias("parts"), F.greatest(F.floor(wanted / 32), F.lit(1)).cast("long").alias("step")))
    if not large.limit(1).count():
        return None
    picked = points.join(large, "f").filter(F.pmod(F.xxhash64("x", "y"), F.col("step")) == 0)
    cuts = picked.groupBy("f", "parts").agg(F.sort_array(F.collect_list(F.struct(first, second))).alias("cuts"))
    at = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda i: F.get("cuts", F.floor(F.size("cuts") * i / F.col("parts")).cast("int")))
    return cut_lineage(cuts.select("f", F.array_distinct(F.array_compact(at)).alias("bounds")).filter(F.size("bounds") > 0))


def _placed(points: DataFrame, bounds: DataFrame | None, first: str, second: str) -> DataFrame:
    """``points`` with the number of their part and of the last part."""
    if bounds is None:
        return points.withColumns({"part": F.lit(0), "last": F.lit(0)})
    passed = F.size(F.filter("bounds", lambda b: b <= F.struct(F.col(first), F.col(second))))
    return points.join(bounds, "f", "left").withColumns({"part": F.when(F.col("bounds").isNull(), 0).otherwise(passed),
                                                         "last": F.when(F.col("bounds").isNull(), 0).otherwise(F.size("bounds"))}).drop("bounds")


def _pack(t: pa.Table) -> pa.Table:
    """The sorted points of a strip in one row, with its sums and box."""
    x, y, w = (t[c].to_numpy() for c in ("x", "y", "w"))
    order = np.lexsort((y, x))
    x, y, w = x[order], y[order], w[order]
    box = {"low_x": x[:1], "high_x": x[-1:], "low_y": [y.min()], "high_y": [y.max()]}
    return pa.table({"f": t["f"][:1], "part": t["part"][:1], **_sums(x, w), **box, "xs": [x.tobytes()], "ys": [y.tobytes()], "ws": [w.tobytes()]})


def _sizes(packs: DataFrame, k: int) -> DataFrame:
    """(f, n, s, k, parts and boxes as arrays): rows, unit of x and strips of a feature."""
    boxes = F.sort_array(F.collect_list(F.struct("part", *_BOX)))
    return _merged(packs, ["f"], boxes.alias("b")).select("f", "n", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s"), F.least(F.lit(k), F.col("n") - 1).cast("int").alias("k"),
                    *[F.col(f"b.{c}").alias(f"b_{c}") for c in ("part", *_BOX)])


def _floats(t: pa.Table, column: str, scale: float = 1.0) -> np.ndarray:
    return np.frombuffer(t[column][0].as_py(), np.float64) / scale


def _ints(t: pa.Table, column: str) -> np.ndarray:
    return np.frombuffer(t[column][0].as_py(), np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _rows(t: pa.Table, schema: str, n: int, head: dict, **columns) -> pa.Table:
    """A row with the columns ``head``, then ``n`` rows with ``columns``; all of the group of ``t``."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(),
             "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    group = {c: pa.chunked_array([pa.repeat(t[c][0], n + 1)]) for c in ("f", "part")}
    for name, kind in (c.split() for c in schema.split(", ")):
        first = pa.array([head.get(name)], kinds[kind])
        rest = pa.nulls(n, kinds[kind]) if name not in columns else columns[name] if isinstance(columns[name], pa.Array) else pa.array(columns[name])
        group[name] = pa.chunked_array([first, rest.cast(kinds[kind])])
    return pa.table(group)


def _histogram(m: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
    m, back = np.unique(m, return_inverse=True)
    return {"m": m.astype(np.int64), "c": np.bincount(back, w, len(m)).astype(np.int64)}


# ------------------------------------------------------------------ neighbours
def _nearest(unit: float):
    """One strip: n_x of its settled points, and its points with d; those that meet other strips with their neighbours here."""
    def run(t: pa.Table) -> pa.Table:
        s, k, part = t["s"][0].as_py(), t["k"][0].as_py(), t["part"][0].as_py()
        raw_x, raw_y, w = _floats(t, "xs"), _floats(t, "ys"), _ints(t, "ws")
        x, y, n = raw_x / s, raw_y / unit, len(w)
        near = nearest_distances(x, y, w, x, y, np.arange(n), k)
        d = near[:, -1]
        parts, low_x, high_x, low_y, high_y = (np.array(t[f"b_{c}"][0].as_py()) / u for c, u in (("part", 1), ("low_x", s), ("high_x", s), ("low_y", unit), ("high_y", unit)))
        points, met = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for j in np.flatnonzero(parts != part):
            at = np.flatnonzero(np.maximum(low_x[j] - x, x - high_x[j]) < d)
            at = at[(np.maximum(low_y[j] - y[at], y[at] - high_y[j]) < d[at]) & (d[at] > 0)]
            points.append(at)
            met.append(np.full(len(at), parts[j], np.int32))
        points, met = np.concatenate(points), np.concatenate(met)
        meets = np.bincount(points, minlength=n)
        asks = meets > 0
        near = near[asks]
        found = np.isfinite(near)
        open_x = asks | _reaches_out(x, x, d, part == parts[0], part == parts[-1])
        upto = np.concatenate([[0], np.cumsum(w)])
        n_x = _inside(x, upto, x[~open_x], d[~open_x])
        return _rows(t, "i int, x double, y double, w long, d double, near array<double>, meets array<int>, open_x boolean, m array<long>, c array<long>", n,
                     _histogram(n_x, w[~open_x]), i=np.arange(n, dtype=np.int32), x=raw_x, y=raw_y, w=w, d=d, open_x=open_x,
                     near=_lists(near[found], np.where(asks, np.bincount(np.flatnonzero(asks), found.sum(axis=1), n), 0)),
                     meets=_lists(met[np.argsort(points, kind="stable")], meets))
    return run


def _across(asking: DataFrame, packs: DataFrame, sizes: DataFrame, unit: float, chunk: int, f: str) -> DataFrame:
    """(f, part, i, x, y, w, d, open_x) of the points that meet other strips, with the distance among all of them."""
    asked = asking.join(sizes.select("f", "s", "k"), "f").select("f", F.explode("meets").alias("to"), "part", "i", (F.col("x") / F.col("s")).alias("x"),
                                                                 (F.col("y") / F.lit(unit)).alias("y"), "d", "k")
    held = packs.select("f", F.col("part").alias("to"), "xs", "ys", "ws").join(sizes.select("f", "s"), "f")

    def near(pack: pa.Table, asked: pa.Table) -> pa.Table:
        d = nearest_distances(_floats(pack, "xs", pack["s"][0].as_py()), _floats(pack, "ys", unit), _ints(pack, "ws"), asked["x"].to_numpy(), asked["y"].to_numpy(),
                              np.full(len(asked), -1), asked["k"][0].as_py(), asked["d"].to_numpy())
        found = np.isfinite(d)
        return pa.table({"f": asked["f"], "part": asked["part"], "i": asked["i"], "near": _lists(d[found], found.sum(axis=1))})

    more = _answered(asked, held, chunk, near, f"{f}, part int, i int, near array<double>")
    own = asking.select("f", "part", "i", "near", "x", "y", "w", "d", "open_x")
    both = own.unionByName(more, allowMissingColumns=True).groupBy("f", "part", "i").agg(
        F.array_sort(F.flatten(F.collect_list("near"))).alias("near"), *[F.max(c).alias(c) for c in ("x", "y", "w", "open_x")])     # strips met x k
    return both.join(sizes.select("f", "k"), "f").select("f", "part", "i", "x", "y", "w", F.get("near", F.col("k") - 1).alias("d"), "open_x")


def _answered(asked: DataFrame, held: DataFrame, chunk: int, answer, schema: str) -> DataFrame:
    """What ``answer`` says to the questions to each (f, to), by what is held there; about ``chunk`` questions a task."""
    load = cut_lineage(asked.groupBy("f", "to").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")))
    asked = asked.join(load, ["f", "to"]).withColumn("chunk", F.pmod(F.xxhash64("part", "i"), F.col("chunks")).cast("int")).drop("chunks")
    held = held.join(load, ["f", "to"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    held = held.withColumnsRenamed({"f": "held_f", "to": "held_to", "chunk": "held_chunk"})
    return held.groupBy("held_f", "held_to", "held_chunk").cogroup(asked.groupBy("f", "to", "chunk")).applyInArrow(answer, schema)


def nearest_distances(x: np.ndarray, y: np.ndarray, weight: np.ndarray, qx: np.ndarray, qy: np.ndarray, own: np.ndarray, k: int,
                      within: np.ndarray | None = None) -> np.ndarray:
    """(queries, k) sorted distances to the nearest of the weighted points; ``own`` is the query's own point or -1.
    With ``within`` only distances below it are looked for."""
    near = np.full((len(qx), k), np.inf)
    if not len(x) or not len(qx):
        return near
    leaf, pad, boxes = _tree(x, y)
    held = np.where(pad, 0, weight[leaf])
    asker = np.full(len(x), -1)
    asker[own[own >= 0]] = np.flatnonzero(own >= 0)
    asker = np.where(pad, -1, asker[leaf])
    c, leaves = leaf.shape[1], len(leaf) if (own >= 0).any() else 0
    # what a point's own leaf holds is an upper bound
    for lo in range(0, leaves, step := max(1, _PAIRS // (c * c))):
        part = slice(lo, lo + step)
        lx, ly = x[leaf[part]], y[leaf[part]]
        d = np.maximum(np.abs(lx[:, :, None] - lx[:, None, :]), np.abs(ly[:, :, None] - ly[:, None, :]))
        order = np.argsort(d, axis=2, kind="stable")
        upto = np.cumsum(np.take_along_axis(held[part][:, None, :] - np.eye(c, dtype=np.int64), order, axis=2), axis=2)
        d, real = np.take_along_axis(d, order, axis=2), asker[part] >= 0
        for j in range(k):
            there = upto > j
            first = np.take_along_axis(d, there.argmax(axis=2)[:, :, None], axis=2)[:, :, 0]
            near[asker[part][real], j] = np.where(there[:, :, -1], first, np.inf)[real]
    bound = near[:, -1].copy() if within is None else np.minimum(near[:, -1], within)
    # askers of one leaf look together, the others one by one
    for groups in (asker[(asker >= 0).any(axis=1)], np.flatnonzero(own < 0)[:, None]):
        for lo in range(0, len(groups), 1024):
            _look_around(groups[lo:lo + 1024], leaf, held, boxes, x, y, qx, qy, own, bound, near)
    return near


def _tree(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Points halved along the wider side of their box: the points of each leaf, which of them only fill it, and the boxes of each level."""
    n = len(x)
    depth = max(0, math.ceil(math.log2(n / _LEAF)))
    fill = (-n) % (1 << depth)
    point = np.concatenate([np.arange(n), np.linspace(0, n - 1, fill).astype(np.int64)])
    px, py, slots, boxes = x[point], y[point], np.arange(n + fill)[None, :], []
    for level in range(depth + 1):
        sx, sy = px[slots], py[slots]
        boxes.append(box := (sx.min(axis=1), sx.max(axis=1), sy.min(axis=1), sy.max(axis=1)))
        if level < depth:
            half = slots.shape[1] // 2
            by = np.where((box[1] - box[0] >= box[3] - box[2])[:, None], sx, sy)
            slots = np.take_along_axis(slots, np.argpartition(by, half, axis=1), axis=1).reshape(-1, half)
    return point[slots], slots >= n, boxes


def _look_around(groups: np.ndarray, leaf: np.ndarray, held: np.ndarray, boxes: list[tuple], x: np.ndarray, y: np.ndarray,
                 qx: np.ndarray, qy: np.ndarray, own: np.ndarray, bound: np.ndarray, near: np.ndarray) -> None:
    """Write to ``near`` the distances below ``bound`` for the queries of some groups (-1: none)."""
    none = groups < 0
    gx, gy, reach = qx[groups], qy[groups], np.where(none, 0, bound[groups]).max(axis=1)
    low_x, high_x, low_y, high_y = (g(np.where(none, e, v), axis=1) for v in (gx, gy) for g, e in ((np.min, np.inf), (np.max, -np.inf)))
    g = np.flatnonzero(reach > 0)
    node = np.zeros(len(g), np.int64)
    for level, (lx, hx, ly, hy) in enumerate(boxes):
        if level:
            g, node = np.repeat(g, 2), (2 * node[:, None] + np.arange(2)).ravel()
        r = reach[g]
        meets = (np.maximum(lx[node] - high_x[g], low_x[g] - hx[node]) < r) & (np.maximum(ly[node] - high_y[g], low_y[g] - hy[node]) < r)
        g, node = g[meets], node[meets]
    if not len(g):
        return
    lx, hx, ly, hy = boxes[-1]
    size, c = groups.shape[1], leaf.shape[1]
    # pieces of whole groups
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    piece = starts * size * c // _PAIRS
    edges = [*starts[np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))], len(g)]
    for lo, hi in zip(edges, edges[1:]):
        q, at = groups[g[lo:hi]].ravel(), np.repeat(node[lo:hi], size)
        q, at = q[q >= 0], at[q >= 0]
        b, ax, ay = bound[q], qx[q], qy[q]
        meets = (np.maximum(lx[at] - ax, ax - hx[at]) < b) & (np.maximum(ly[at] - ay, ay - hy[at]) < b)
        q, at = q[meets], at[meets]
        points = leaf[at]
        d = np.maximum(np.abs(x[points] - qx[q][:, None]), np.abs(y[points] - qy[q][:, None]))
        row, col = np.nonzero(d < bound[q][:, None])
        q, d, w = q[row], d[row, col], held[at[row], col]
        w = w - ((points[row, col] == own[q]) & (w > 0))
        order = np.lexsort((d, q))
        q, d, w = q[order], d[order], w[order]
        upto = np.cumsum(w)
        first = np.concatenate([[True], q[1:] != q[:-1]])[:len(q)]
        upto -= np.repeat((upto - w)[first], np.diff([*np.flatnonzero(first), len(q)]))
        for j in range(near.shape[1]):
            here = (upto > j) & (upto - w <= j)
            near[q[here], j] = d[here]


# ------------------------------------------------------------------ counts
def _passed(v: np.ndarray, at: np.ndarray, d: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How many of the sorted values are left of each interval (``low``), or not beyond its end."""
    first, last = np.zeros(len(at), np.int64), np.full(len(at), len(v), np.int64)
    while (first < last).any():                                               # the first value that is not passed
        mid = (first + last) // 2
        x = v[np.minimum(mid, len(v) - 1)]
        left = np.where(d > 0, at - x >= d, at - x > 0)
        inside = np.where(d > 0, x - at < d, x - at <= 0)
        passed = np.where(low, left, inside) & (first < last)
        first, last = np.where(passed, mid + 1, first), np.where(passed | (first >= last), last, mid)
    return first


def _inside(v: np.ndarray, upto: np.ndarray, at: np.ndarray, d: np.ndarray) -> np.ndarray:
    return upto[_passed(v, at, d, np.False_)] - upto[_passed(v, at, d, np.True_)]


def _reaches_out(v: np.ndarray, at: np.ndarray, d: np.ndarray, is_first: bool, is_last: bool) -> np.ndarray:
    """Whether an interval may hold values before the first or after the last of the sorted values."""
    out = lambda gap: np.where(d > 0, gap < d, gap <= 0)
    none = np.zeros(len(at), bool)
    return (none if is_first else out(at - v[0])) | (none if is_last else out(v[-1] - at))


def _count(unit: float, keep: bool):
    """One block: n_y of its settled points; if ``keep``, its sorted values and the points whose interval reaches out."""
    def run(t: pa.Table) -> pa.Table:
        raw, w, d = (t[c].to_numpy() for c in ("y", "w", "d"))
        order = np.argsort(raw, kind="stable")
        raw, w, d = raw[order], w[order], d[order]
        v = raw / unit
        upto = np.concatenate([[0], np.cumsum(w)])
        part = t["part"][0].as_py()
        out = _reaches_out(v, v, d, part == 0, part == t["last"][0].as_py())
        head = _histogram(_inside(v, upto, v[~out], d[~out]), w[~out]) | {"n": int(upto[-1]), "low": raw[0]}
        if keep:
            head |= {"vs": raw.tobytes(), "ws": w.tobytes()}
        return _rows(t, "i int, v double, w long, d double, n long, low double, vs binary, ws binary, m array<long>, c array<long>", int(out.sum()), head,
                     i=np.flatnonzero(out).astype(np.int32), v=v[out], w=w[out], d=d[out])
    return run


def _look_up(probes: DataFrame, held: DataFrame, chunk: int, f: str) -> DataFrame:
    """(f, m, w): rows inside the intervals (f, part, i, w, v, d), by the sorted values (f, part, n, low, vs, ws, scale) of all parts."""
    order = Window.partitionBy("f").orderBy("part")                           # one row a part
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = cut_lineage(held.select("f", "part", (F.col("low") / F.col("scale")).alias("low"), before.alias("before"), (F.row_number().over(order) - 1).alias("to")))
    firsts = places.groupBy("f").agg(F.sort_array(F.collect_list("low")).alias("firsts"))
    # the last part that begins before the interval, and the last that begins before its end
    ends = F.array(F.struct(F.lit(1).alias("side"), F.size(F.filter("firsts", lambda v: _left(F.col("v") - v))).alias("n")),
                   F.struct(F.lit(2).alias("side"), F.size(F.filter("firsts", lambda v: ~_left(v - F.col("v"), strict=True))).alias("n")))
    asked = probes.join(cut_lineage(firsts), "f").withColumn("e", F.explode(ends)) \
        .select("f", "part", "i", "w", "v", "d", F.greatest(F.col("e.n") - 1, F.lit(0)).alias("to"), F.col("e.side").alias("side"))
    held = held.join(places.select("f", "part", "to", "before"), ["f", "part"]).select("f", "to", "before", "scale", "vs", "ws")

    def count(block: pa.Table, asked: pa.Table) -> pa.Table:
        v = _floats(block, "vs", block["scale"][0].as_py())
        upto = np.concatenate([[0], np.cumsum(_ints(block, "ws"))]) + block["before"][0].as_py()
        low = asked["side"].to_numpy() == 1
        n = upto[_passed(v, asked["v"].to_numpy(), asked["d"].to_numpy(), low)]
        return pa.table({"f": asked["f"], "part": asked["part"], "i": asked["i"], "w": asked["w"], "m": np.where(low, -n, n)})

    found = _answered(asked, held, chunk, count, f"{f}, part int, i int, w long, m long")
    return found.groupBy("f", "part", "i").agg(F.sum("m").alias("m"), F.max("w").alias("w")).select("f", "m", "w")


def _left(gap: Column, strict: bool = False) -> Column:
    """Whether a value that is ``gap`` to the left (or right: ``strict`` keeps its own value in) is outside the interval."""
    return F.when(F.col("d") > 0, gap >= F.col("d")).otherwise(gap > 0)
