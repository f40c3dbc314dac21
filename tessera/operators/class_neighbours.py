"""k-nearest-neighbour mutual information between a continuous feature and a class
(Ross 2014; the estimator behind scikit-learn's ``mutual_info_classif``, without its random jitter).

    mi = psi(n) + mean(psi(k)) - mean(psi(n_class)) - mean(psi(m)), at least 0,

d is a point's distance to its k-th neighbour of its own class, m counts the points of any class
strictly inside the open interval (x - d, x + d) as computed in IEEE arithmetic ([x, x] when d = 0).

1. Equal points are one row with weights, so a value that fills most of a feature is one row.
2. A feature with more than ``block_values`` different points is cut into blocks at approximate
   quantiles.  Where the cuts fall changes the work of a block, never a result.
3. A block is sorted in its task.  A point whose interval lies inside the block is settled there:
   neither its neighbours nor its count can be elsewhere.  Only some k points at either end of each
   class are left open; they are written with the points around them.
4. The open points of a class find their neighbours among those of all blocks, and the two ends of
   their intervals are looked up in the blocks that hold them.

The rows are shuffled to their blocks once; steps 4's tables have some k rows per block and class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.stats import digamma_int
from tessera.session import cut_lineage, ship_package

BLOCK_VALUES = 1 << 15
_BLOCK = "f string, block int, c int, x double, rows long, points long, single long, ny long, is_open boolean, xs binary, upto binary, m array<long>, w array<long>"


def mutual_info_knn(cells: DataFrame, labels: DataFrame, key: str, feature: str, value: str, y: str, k: int = 3,
                    block_values: int = BLOCK_VALUES) -> DataFrame:
    """(feature, mi).  Classes seen once are dropped.  Rows of one key with the same value and class are one
    point; as neighbours and in the size of the class they count as often as they come."""
    ship_package(cells.sparkSession)
    points, classes = _points(cells, labels, key, feature, value, y)
    bounds = _bounds(points, block_values)
    if bounds is None:                                                    # every feature is one block
        placed = points.withColumns({"block": F.lit(0), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    else:
        placed = points.join(bounds, "f", "left").withColumn("block", _block_of("x")) \
            .withColumns({"low": F.get("bounds", F.col("block") - 1), "high": F.get("bounds", F.col("block"))}).drop("bounds")
    blocks = placed.groupBy("f", "block").applyInPandas(_settle(k, bounds is not None), _BLOCK)
    if bounds is not None:
        blocks = cut_lineage(blocks)
    counts = blocks.filter("c is null").select("f", F.explode(F.arrays_zip("m", "w")).alias("q")).select("f", "q.m", "q.w")
    if bounds is not None:
        counts = counts.unionByName(_settle_open(blocks, bounds, k))
    psi = counts.filter("m > 0").groupBy("f").agg((F.sum(F.col("w") * digamma_int("m")) / F.sum("w")).alias("psi"))
    n = F.sum("points")
    sums = classes.groupBy("f").agg(n.alias("n"), (F.sum(F.col("points") * digamma_int(F.least(F.lit(k), F.col("ny") - 1))) / n).alias("psi_k"),
                                    (F.sum(F.col("points") * digamma_int("ny")) / n).alias("psi_ny"))
    mi = digamma_int("n") + F.col("psi_k") - F.col("psi_ny") - F.col("psi")
    return sums.join(psi, "f", "left").select(F.col("f").alias(feature), F.greatest(mi, F.lit(0.0)).alias("mi"))


def _points(cells: DataFrame, labels: DataFrame, key: str, feature: str, value: str, y: str) -> tuple[DataFrame, DataFrame]:
    """(f, c, x, rows, points, single, ny): different points, how many rows and keys hold each, how many keys in one row;
    and (f, c, points, ny) of the classes that have more than one row."""
    j = (cells.filter(F.col(value).isNotNull()).join(labels.filter(F.col(y).isNotNull()), key)
              .select(F.col(feature).alias("f"), F.col(y).alias("y"), F.col(value).cast("double").alias("x"), F.col(key).cast("string").alias("_pid")))
    own = j.groupBy("f", "y", "x", "_pid").agg(F.count(F.lit(1)).alias("_r"))
    points = cut_lineage(own.groupBy("f", "y", "x").agg(F.sum("_r").alias("rows"), F.count(F.lit(1)).alias("points"), F.count_if(F.col("_r") == 1).alias("single")))
    classes = points.groupBy("f", "y").agg(F.sum("rows").alias("ny"), F.sum("points").alias("points")).filter("ny > 1")
    classes = cut_lineage(classes.withColumn("c", F.row_number().over(Window.partitionBy("f").orderBy("y"))))      # features x classes rows
    return points.join(classes.select("f", "y", "c", "ny"), ["f", "y"]).drop("y"), classes.drop("y")


def _bounds(points: DataFrame, block_values: int) -> DataFrame | None:
    """(f, bounds): where features with more than ``block_values`` different points are cut; None if there are none."""
    sizes = cut_lineage(points.groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_values))
    most = sizes.agg(F.max("n")).first()[0]                               # one number
    if most is None:
        return None
    blocks = -(-most // block_values)
    cuts = F.percentile_approx("x", F.array(*[F.lit(i / blocks) for i in range(1, blocks)]), F.lit(max(10000, 20 * blocks)))
    own = F.ceil(F.col("n") / F.lit(block_values)).cast("int")            # every feature takes as many cuts as it needs
    fewer = F.transform(F.sequence(F.lit(1), own - 1), lambda i: F.get("cuts", F.floor(i * F.lit(blocks) / own).cast("int") - 1))
    found = points.join(sizes, "f").groupBy("f", "n").agg(cuts.alias("cuts"))
    return cut_lineage(found.select("f", F.array_distinct(fewer).alias("bounds")))


def _block_of(v: str):
    """The block that holds a value: how many bounds it has reached."""
    return F.coalesce(F.size(F.filter("bounds", lambda b: b <= F.col(v))), F.lit(0))


def _distances(rows: np.ndarray, x: np.ndarray, k: int, kk: int) -> np.ndarray:
    """Distance of each sorted value, held ``rows`` times, to its kk-th nearest row (inf if there is none)."""
    copies = np.minimum(rows, k + 1)
    wide, first = np.repeat(x, copies), np.cumsum(copies) - copies
    near = np.full((2 * k + 1, len(x)), np.inf)
    for o in range(-k, k + 1):
        at = first + o
        there = (at >= 0) & (at < len(wide))
        near[o + k, there] = np.abs(wide[at[there]] - x[there])
    return np.sort(near, axis=0)[kk]


def _ends(x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x - d, x + d


def _inside(v: np.ndarray, upto: np.ndarray, x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many points of the sorted values lie inside each interval."""
    low, high = _ends(x, d)
    open_ = ~(d <= 0)                                                     # NaN is above all numbers, as in Spark
    first = np.where(open_, np.searchsorted(v, low, "right"), np.searchsorted(v, low, "left"))
    last = np.where(open_, np.searchsorted(v, high, "left"), np.searchsorted(v, high, "right"))
    return upto[last] - upto[first]


def _settle(k: int, keep: bool):
    """One block: (m, w) of its settled points, its sorted values if ``keep``, and its open points with those around them."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x", kind="stable")
        f, block = pdf["f"].iloc[0], pdf["block"].iloc[0]
        low, high = (-np.inf if pd.isna(pdf["low"].iloc[0]) else pdf["low"].iloc[0]), (np.inf if pd.isna(pdf["high"].iloc[0]) else pdf["high"].iloc[0])
        all_x, all_c = pdf["x"].to_numpy(), pdf["c"].to_numpy()
        upto = np.concatenate([[0], np.cumsum(pdf["points"].to_numpy().astype(np.int64))])
        ms, ws, shown = [], [], []
        for c in np.unique(all_c):
            part = np.flatnonzero(all_c == c)
            own = pdf.iloc[part]
            x, rows, single, points = all_x[part], own["rows"].to_numpy(), own["single"].to_numpy(), own["points"].to_numpy()
            d = _distances(rows, x, k, min(k, int(own["ny"].iloc[0]) - 1))
            to_low, to_high = _ends(x, d)
            with np.errstate(invalid="ignore"):
                is_open = (to_low < low) | (x - low < d) | (to_high > high) | (high - x < d)
            zero = _inside(all_x, upto, x, np.zeros(len(x)))
            ms += [_inside(all_x, upto, x, d)[~is_open], zero]
            ws += [single[~is_open], points - single]                     # a key of several rows is its own neighbour
            if not keep:
                continue
            n, near = len(x), np.zeros(len(x) + 1, np.int64)
            at = np.flatnonzero(is_open)
            np.add.at(near, np.maximum(at - k, 0), 1)
            np.add.at(near, np.minimum(at + k + 1, n), -1)
            take = np.cumsum(near[:n]) > 0
            take[:k] = True
            take[max(0, n - k):] = True
            shown.append(own[take].assign(is_open=is_open[take]))
        m, w = np.concatenate(ms), np.concatenate(ws)
        m, back = np.unique(m[w > 0], return_inverse=True)
        w = np.bincount(back, w[w > 0], len(m)).astype(np.int64)
        head = pd.DataFrame({"f": [f], "block": [block], "points": [int(upto[-1])], "m": [m], "w": [w], "xs": [all_x.tobytes() if keep else None], "upto": [upto.tobytes() if keep else None]})
        out = pd.concat([head, *shown]).reindex(columns=[c.split()[0] for c in _BLOCK.split(", ")])
        lists = {c: out[c].astype(object).where(out[c].notna(), None) for c in ("xs", "upto", "m", "w")}
        return out.astype({c: "Int64" for c in ("c", "rows", "points", "single", "ny")} | {"is_open": "boolean"}).assign(f=np.full(len(out), f, object), **lists)
    return run


def _settle_open(blocks: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """(f, m, w) of the points whose interval reaches beyond their block."""
    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x", kind="stable")
        d = _distances(pdf["rows"].to_numpy(), pdf["x"].to_numpy(), k, min(k, int(pdf["ny"].iloc[0]) - 1))
        asked = pdf.assign(d=d)[pdf["is_open"].to_numpy(bool) & (pdf["single"].to_numpy() > 0)]
        return asked[["c", "x", "single", "d"]].assign(f=np.full(len(asked), pdf["f"].iloc[0], object))

    found = blocks.filter("c is not null").select("f", "c", "x", "rows", "single", "ny", "is_open").groupBy("f", "c") \
        .applyInPandas(near, "f string, c int, x double, single long, d double")
    found = cut_lineage(found)
    ends = F.array(*[F.struct(F.lit(side).alias("side"), (F.col("x") + side * F.col("d")).alias("v")) for side in (-1, 1)])
    probes = found.withColumn("e", F.explode(ends)).select("f", "c", "x", "single", "e.*", (F.col("d") > 0).alias("wide")) \
        .join(bounds, "f").withColumn("block", _block_of("v")).drop("bounds")
    held = blocks.filter("c is null")
    before = F.coalesce(F.sum("points").over(Window.partitionBy("f").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select("f", "block", "points").withColumn("before", before)      # one row a block
    # a value whose block is empty has all the blocks below before it
    last = offsets.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("block", "before", "points"))).alias("all"))
    below = F.filter("all", lambda b: b["block"] <= F.col("block"))
    placed = probes.join(last, "f").withColumn("b", F.try_element_at(below, F.lit(-1))).drop("all", "block") \
        .select("*", F.col("b.block").alias("block"), F.coalesce("b.before", F.lit(0)).alias("before")).drop("b")

    def look(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        xs, upto = (np.frombuffer(block[c].iloc[0], t) if len(block) else np.zeros(n, t) for c, t, n in (("xs", np.float64, 0), ("upto", np.int64, 1)))
        v = asked["v"].to_numpy()
        left = (asked["side"].to_numpy() > 0) == asked["wide"].to_numpy(bool)
        n = asked["before"].to_numpy() + upto[np.where(left, np.searchsorted(xs, v, "left"), np.searchsorted(xs, v, "right"))]
        return asked[["c", "x", "single"]].assign(f=np.full(len(asked), (asked if len(asked) else block)["f"].iloc[0], object), count=n * asked["side"].to_numpy())

    arrays = held.select("f", "block", "xs", "upto").groupBy("f", "block")
    counted = arrays.cogroup(placed.groupBy("f", "block")).applyInPandas(look, "f string, c int, x double, single long, count long")
    return counted.groupBy("f", "c", "x").agg(F.sum("count").alias("m"), F.first("single").alias("w")).select("f", "m", "w")
