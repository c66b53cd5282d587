"""Predicates and measures on intervals given as (start, end) in seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the common hull; 0 for an empty hull."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, overlap(s1, e1, s2, e2) / hull).otherwise(F.lit(0.0))


def overlap_fraction(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the shorter length; 0 if that is not positive."""
    shorter = F.least(e1 - s1, e2 - s2)
    return F.when(shorter > 0, overlap(s1, e1, s2, e2) / shorter).otherwise(F.lit(0.0))


def same_core(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether two cores tell of one occurrence: high IoU, or high overlap at similar lengths."""
    shorter, longer = F.least(e1 - s1, e2 - s2), F.greatest(e1 - s1, e2 - s2)
    near = (overlap_fraction(s1, e1, s2, e2) >= C.DEDUPE_OVERLAP) & (longer / F.when(shorter > 0, shorter).otherwise(F.lit(1.0)) <= C.DEDUPE_LENGTH_RATIO)
    return (shorter > 0) & ((iou(s1, e1, s2, e2) >= C.DEDUPE_IOU) | near)


def contains(outer_s: Column, outer_e: Column, s: Column, e: Column) -> Column:
    return (outer_s <= s) & (outer_e >= e)


def valid_interval(s: Column, e: Column) -> Column:
    """Both present and finite, not negative, end after start."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(finite(s) & finite(e) & (s >= 0) & (e > s), F.lit(False))


def required_interval(s: Column, e: Column, name: str) -> Column:
    """(start, end), or an error when it is read that names the interval that isn't valid."""
    wrong = F.raise_error(F.concat(F.lit(f"{name} is no valid interval: "), F.coalesce(s.cast("string"), F.lit("null")), F.lit(", "), F.coalesce(e.cast("string"), F.lit("null"))))
    return F.when(valid_interval(s, e), F.struct(s.alias("start"), e.alias("end"))).otherwise(wrong.cast("struct<start:double,end:double>"))
