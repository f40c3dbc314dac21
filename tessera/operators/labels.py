"""Labelling, cohort and key operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PID = "patient_id"


def label_exact(clinic, target: str = "any") -> Column:
    """Case-folded clinic -> 0/1: healthy -> 0; ``any`` -> 1 for everything else;
    ``lung``/``heme`` -> 1 only on an exact match.

    A missing clinic reads as the text ``nan`` (the reference stringifies it),
    so it counts as "not healthy".
    """
    s = F.lower(F.coalesce(clinic if isinstance(clinic, Column) else F.col(clinic), F.lit("nan")))
    if target == "any":
        hit = F.lit(1)
    elif target in ("lung", "heme"):
        hit = (s == target).cast("int")
    else:
        raise ValueError(f"unknown target {target!r}")
    return F.when(s == "healthy", F.lit(0)).otherwise(hit)


def label_contains(status, term: str, case: bool = True) -> Column:
    """1 when ``term`` occurs in the status text (NULL status -> 0)."""
    s = status if isinstance(status, Column) else F.col(status)
    if case:
        hit = s.contains(term)
    else:
        hit = F.lower(s).contains(term.lower())
    return F.coalesce(hit.cast("int"), F.lit(0))


def attach(cells: DataFrame, labels: DataFrame, how: str = "inner", key: str = PID) -> DataFrame:
    """Attach per-patient labels to cells.  ``inner`` keeps shared patients, ``left``
    keeps unlabelled ones.  Labels are one row per patient; AQE broadcasts them
    when their runtime size is under the threshold, otherwise sort-merge."""
    return cells.join(labels, key, how)


def missing(labels: DataFrame, cells: DataFrame, key: str = PID) -> DataFrame:
    """Labelled patients absent from the matrix."""
    return labels.select(key).distinct().join(cells.select(key), key, "left_anti")


def range_bucket(v, lo: float, hi: float, names=("healthy", "average", "below")) -> Column:
    """Three open ranges: v < lo, lo < v < hi, v > hi.  Bounds and NULL fall in none."""
    c = v if isinstance(v, Column) else F.col(v)
    return F.when(c < lo, F.lit(names[0])).when((c > lo) & (c < hi), F.lit(names[1])).when(c > hi, F.lit(names[2]))


def normalize_id(c, strip: str = "X") -> Column:
    """Remove a marker character from identifiers (``X123`` -> ``123``)."""
    return F.regexp_replace(c if isinstance(c, Column) else F.col(c), strip, "")
