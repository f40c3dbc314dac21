"""Scalar numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def pyround(c, digits: int = 2) -> Column:
    """Round a double the way ``round(numpy.float64, d)`` does: scale by 10^d,
    round half to even (``rint``), unscale.  The reference rounds numpy
    scalars, and the same three IEEE steps give identical results in SQL."""
    scale = float(10 ** digits)
    # "+ 0.0" turns a rounded negative zero into 0.0
    return F.rint(col_(c) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def pct_change(old, new, digits: int | None = 2) -> Column:
    """``(new - old) / old * 100``; NULL when ``old`` is 0 or NULL."""
    v = F.try_divide(col_(new) - col_(old), col_(old)) * F.lit(100.0)
    return pyround(v, digits) if digits is not None else v


def threshold_class(p, t: float = 0.5) -> Column:
    """1 when the score is strictly above ``t``, else 0 (NULL stays NULL)."""
    return (col_(p) > F.lit(t)).cast("int")


def round_class(p) -> Column:
    """``round(p)`` of a probability, half to even (0.5 -> 0)."""
    return F.bround(col_(p), 0).cast("int")
