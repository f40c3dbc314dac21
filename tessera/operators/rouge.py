"""Summary-level ROUGE-L and bootstrap intervals of scores.

``rouge_lsum`` scores a text sentence by sentence: a word of a reference sentence counts if
it stands in the longest common subsequence with any predicted sentence (their union), and no
word counts more often than either text holds it.

``bootstrap_scores`` gives low, mid and high percentiles of the mean of each score over seeded
resamples of the rows.  A resample weighs every row by a Poisson(1) count that depends on the
row's key, the seed and the resample's number alone, so all resamples come from one scan as
weighted sums: tasks return (resamples x scores) sums, whatever their rows, and neither rows nor
weights are shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as TX
from tessera.functions.random import hash_key
from tessera.operators.text import sentences
from tessera.session import ship_package

# fixed values: golden-ratio step and the two multipliers of a 32-bit finaliser
STEP, MULT1, MULT2 = 0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35
BLOCK = 4096
#: Poisson(1) counts by inversion: a 32-bit number below the k-th mark counts less than k + 1
MARKS = [math.floor(2 ** 32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(10)]


def common_positions(ref: Sequence[str], pred: Sequence[str]) -> list[int]:
    """Positions in ``ref`` of one longest common subsequence.

    It is read from the ends of both: equal words belong to it; else the last word is left
    out on the side that keeps the longer subsequence, on ties that of ``ref``.  A row of the
    table is one big integer (a zero bit where the length grows)."""
    masks: dict = {}
    for j, w in enumerate(pred):
        masks[w] = masks.get(w, 0) | 1 << j
    full = row = (1 << len(pred)) - 1
    rows = [row]
    for w in ref:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)

    def length(i, j):
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    out, i, j = [], len(ref), len(pred)
    while i and j:
        if ref[i - 1] == pred[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif length(i, j - 1) > length(i - 1, j):
            j -= 1
        else:
            i -= 1
    return out[::-1]


def union_hits(pred: Sequence[Sequence[str]], ref: Sequence[Sequence[str]]) -> int:
    """Words of the reference sentences in the union of their common subsequences with all
    predicted ones, each at most as often as either side holds it."""
    left_p = Counter(w for s in pred for w in s)
    left_r = Counter(w for s in ref for w in s)
    hits = 0
    for r in ref:
        for i in sorted({i for p in pred for i in common_positions(r, p)}):
            if left_p[r[i]] > 0 and left_r[r[i]] > 0:
                left_p[r[i]] -= 1
                left_r[r[i]] -= 1
                hits += 1
    return hits


@F.pandas_udf(T.LongType())
def _union_udf(pred: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([union_hits([list(s) for s in p], [list(s) for s in r]) for p, r in zip(pred, ref)], dtype="int64")


def rouge_lsum(df: DataFrame, key: str, pred: str, ref: str) -> DataFrame:
    """key, hits and summary-level ROUGE-L precision, recall and F1 (0 where a text has no word;
    a null text has none)."""
    ship_package(df.sparkSession)

    def parts(text):
        return F.filter(F.transform(sentences(text), TX.words), lambda s: F.size(s) > 0)

    def n(parts):
        return F.aggregate(parts, F.lit(0), lambda a, s: a + F.size(s))

    w = df.select(key, parts(pred).alias("_p"), parts(ref).alias("_r")).withColumn("_h", _union_udf("_p", "_r"))
    prec = F.coalesce(F.try_divide(F.col("_h").cast("double"), n(F.col("_p"))), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("_h").cast("double"), n(F.col("_r"))), F.lit(0.0))
    f1 = F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return w.select(key, F.col("_h").alias("hits"), prec.alias("rougeLsum_p"), rec.alias("rougeLsum_r"), f1.alias("rougeLsum_f"))


def _mix(x: np.ndarray) -> np.ndarray:
    """32-bit finaliser on numbers below 2^32 (uint64)."""
    low = np.uint64(0xFFFFFFFF)
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(MULT1)) & low
    x = x ^ (x >> np.uint64(13))
    x = (x * np.uint64(MULT2)) & low
    return x ^ (x >> np.uint64(16))


def weights(h: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """Poisson(1) counts, one row per resample, from 64-bit row hashes."""
    low = np.uint64(0xFFFFFFFF)
    step = (samples.astype(np.uint64)[:, None] * np.uint64(STEP)) & low
    x = _mix(((h >> np.uint64(32))[None, :] + step) & low)
    return np.searchsorted(np.array(MARKS, np.uint64), _mix(x ^ (h & low)[None, :]), side="right")


def _summed(samples: int, n_scores: int):
    def run(batches):
        sums = np.zeros((samples, n_scores + 1))
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            x = np.column_stack([np.ones(len(h))] + [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])
            for a in range(0, len(h), BLOCK):
                for b in range(0, samples, 256):
                    part = np.arange(b, min(b + 256, samples))
                    sums[part] += weights(h[a:a + BLOCK], part) @ x[a:a + BLOCK]
        if sums[:, 0].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples), pa.int32())] + [pa.array(c) for c in sums.T],
                                             ["sample", "w"] + [f"s{i}" for i in range(n_scores)])
    return run


def bootstrap_scores(df: DataFrame, key: str, scores: Sequence[str], samples: int = 1000, confidence: float = 0.95, seed=0) -> DataFrame:
    """score, low, mid, high: percentiles of the mean of each score over the resamples.

    Percentiles interpolate between order statistics.  Rows with a null score are left out;
    rows of one key are resampled together; a resample that draws no row has no mean and is
    left out; without rows the percentiles are null."""
    ship_package(df.sparkSession)
    hex16 = F.substring(F.md5(hash_key(seed, key)), 1, 16)
    # 16 hex digits as a signed 64-bit number, by halves
    h = F.shiftleft(F.conv(F.substring(hex16, 1, 8), 16, 10).cast("bigint"), 32).bitwiseOR(F.conv(F.substring(hex16, 9, 8), 16, 10).cast("bigint"))
    rows = df.dropna(subset=list(scores)).select(h.alias("h"), *[F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(scores)])
    schema = "sample int, w double, " + ", ".join(f"s{i} double" for i in range(len(scores)))
    sums = rows.mapInArrow(_summed(samples, len(scores)), schema).groupBy("sample").agg(*[F.sum(c).alias(c) for c in ["w"] + [f"s{i}" for i in range(len(scores))]])
    means = sums.filter("w > 0").select(*[(F.col(f"s{i}") / F.col("w")).alias(f"s{i}") for i in range(len(scores))])
    marks = [(1 - confidence) / 2, 0.5, (1 + confidence) / 2]
    # one row per resample: percentile holds no more than their number
    ends = means.agg(*[F.percentile(f"s{i}", F.array(*[F.lit(m) for m in marks])).alias(f"s{i}") for i in range(len(scores))])
    named = F.array(*[F.struct(F.lit(c).alias("score"), F.col(f"s{i}").alias("p")) for i, c in enumerate(scores)])
    return ends.select(F.explode(named).alias("x")).select("x.score", *[F.get("x.p", F.lit(i)).alias(n) for i, n in enumerate(("low", "mid", "high"))])
