"""Seeded, engine-portable uniform numbers.

``uniform(seed, key...)`` maps a seed and key columns to [0, 1) through the
first 32 bits of ``md5(seed|key|...)``.  Any SQL engine with ``md5`` can
reproduce it (DuckDB: ``('0x'||substr(md5(s),1,8))::bigint/4294967296.0``), it
is a pure function of the row (so a recomputed partition after executor loss
gives the same value) and it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32 = 4294967296.0


def _as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def hash_key(seed, *keys) -> Column:
    """``seed|k1|k2...`` as a string column (keys must be non-null)."""
    parts = [F.lit(str(seed))] + [_as_col(k).cast("string") for k in keys]
    return F.concat_ws("|", *parts)


def uniform(seed, *keys) -> Column:
    """Deterministic U[0,1) draw for each row, keyed by ``seed`` and ``keys``."""
    hex8 = F.substring(F.md5(hash_key(seed, *keys)), 1, 8)
    return F.conv(hex8, 16, 10).cast("bigint") / F.lit(_TWO_32)


def uniform_between(seed, lo: float, hi: float, *keys) -> Column:
    """Deterministic U[lo, hi) draw."""
    return F.lit(lo) + F.lit(hi - lo) * uniform(seed, *keys)
