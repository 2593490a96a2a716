"""Interval predicates and ratios on closed intervals of one chromosome, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chromosome(c: Column) -> Column:
    """Chromosome name without its ``chr`` prefix."""
    return F.regexp_replace(c, "^chr", "")


def strand(c: Column) -> Column:
    """``+`` or ``-``; anything else is ``.``."""
    return F.when(c.isin("+", "-"), c).otherwise(".")


def is_valid(start: Column, end: Column) -> Column:
    return (start > 0) & (end >= start)


def is_upstream(end: Column, other_start: Column, distance: int = 0) -> Column:
    """The interval ends ``distance`` or more before the other starts."""
    return other_start - end >= abs(distance)


def is_downstream(start: Column, other_end: Column, distance: int = 0) -> Column:
    return start - other_end >= abs(distance)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Closed overlap: a shared base is enough."""
    return (s1 <= e2) & (e1 >= s2)


def overlaps_within(s1: Column, e1: Column, s2: Column, e2: Column, distance: int = 0) -> Column:
    """Neither upstream nor downstream at this distance; touching intervals do not overlap at 0."""
    return ~is_upstream(e1, s2, distance) & ~is_downstream(s1, e2, distance)


def close(a: Column, b: Column, error: int) -> Column:
    return F.abs(a - b) < error


def tolerant_order(s1: Column, e1: Column, s2: Column, e2: Column, error: int) -> Column:
    """-1, 0 or 1: by start, then end; differences below ``error`` do not count."""
    by_end = F.when(close(e1, e2, error), 0).when(e1 < e2, -1).otherwise(1)
    return F.when(close(s1, s2, error), by_end).when(s1 < s2, -1).otherwise(1)


def overlap_percent(s1: Column, e1: Column, s2: Column, e2: Column, mode: str = "self") -> Column:
    """Overlap length as a percentage of the first interval (self), the hull of both (hull) or the shorter (narrow).

    Lengths are end - start; disjoint intervals give a negative number, an empty denominator null.
    """
    length = F.least(e1, e2) - F.greatest(s1, s2)
    whole = {"self": e1 - s1, "hull": F.greatest(e1, e2) - F.least(s1, s2), "narrow": F.least(e1 - s1, e2 - s2)}[mode]
    return F.try_divide(length.cast("double") * 100, whole.cast("double"))
