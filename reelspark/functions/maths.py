"""Small scalar expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Shared length of two intervals, zero when disjoint."""
    return F.greatest(F.lit(0.0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def half_even(value: Column) -> Column:
    """Round to an integer, ties to even."""
    return F.bround(value).cast("bigint")


def cosine_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle in degrees between two vectors; a vanishing vector counts as 180 degrees."""
    norm = F.hypot(ax, ay) * F.hypot(bx, by)
    ratio = (ax * bx + ay * by) / F.when(norm > 1e-9, norm)
    return F.when(norm <= 1e-9, F.lit(180.0)).otherwise(F.degrees(F.acos(clamp(ratio, -1.0, 1.0))))


def mean_or(value: Column, default: float = 0.0) -> Column:
    """Mean of a group with a stated value for the empty group."""
    return F.coalesce(F.avg(value), F.lit(float(default)))


def ratio_of(condition: Column) -> Column:
    """Share of rows that satisfy a condition, zero for an empty group."""
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0))


def majority(condition: Column) -> Column:
    """Strict majority vote: more than half of the rows."""
    return F.count_if(condition) * 2 > F.count(F.lit(1))


def weighted_mean(weight: Column, value: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.sum(weight * value) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(float(default)))


def uniform(text: Column) -> Column:
    """Repeatable number in [0, 1) from the first 32 bits of a text's SHA-256."""
    return hash32(text).cast("double") / F.lit(float(2**32))


def hash32(text: Column) -> Column:
    """First eight hex digits of a text's SHA-256 as an integer."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def first_peak(values: Column) -> Column:
    """Zero-based position of the first maximum of an array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("bigint")
