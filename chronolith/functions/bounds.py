"""From clip-local times to times of the source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .coerce import fixed
from .intervals import valid_interval


def _bounds(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def source_core(cand_s: Column, cand_e: Column, s: Column, e: Column, duration: Column) -> Column:
    """The core's place in the source, or null: local times must lie in the candidate without tolerance and be in order."""
    fits = _finite(s) & _finite(e) & (s >= 0) & (e <= cand_e - cand_s) & (e > s)
    start = fixed(F.greatest(F.lit(0.0), F.least(duration, cand_s + s)))
    end = fixed(F.greatest(F.lit(0.0), F.least(duration, cand_s + e)))
    return F.when(F.coalesce(fits, F.lit(False)) & (end > start), _bounds(start, end))


def tolerant_bounds(cand_s: Column, cand_e: Column, s: Column, e: Column, duration: Column) -> Column:
    """start, end, refined: local times within a tolerance of the candidate, else the candidate itself and refined = false."""
    length = cand_e - cand_s
    fits = F.coalesce(_finite(s) & _finite(e) & (s >= -C.BOUND_TOLERANCE) & (e <= length + C.BOUND_TOLERANCE) & (e > s), F.lit(False))
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(length, x))
    at = lambda x: fixed(F.greatest(F.lit(0.0), F.least(duration, cand_s + clamp(x))))
    fits = fits & (at(e) > at(s))
    return F.struct(F.when(fits, at(s)).otherwise(cand_s).alias("start"), F.when(fits, at(e)).otherwise(cand_e).alias("end"), fits.alias("refined"))


def padded_bounds(bounds: Column, padding: Column, duration: Column) -> Column:
    return _bounds(fixed(F.greatest(F.lit(0.0), bounds["start"] - padding)), fixed(F.least(duration, bounds["end"] + padding)))


def clip_bounds(status: Column, start: Column, end: Column) -> Column:
    """The clip's bounds of a completed result with a valid interval, else null."""
    return F.when((status == "completed") & valid_interval(start, end), _bounds(start, end))
