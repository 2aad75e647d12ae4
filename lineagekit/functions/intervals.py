"""Intervals with open, closed or missing ends, units, and three-valued judgements. Column expressions.

An interval is a struct (lower, lower_inclusive, upper, upper_inclusive); a null end is unbounded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def interval(lower: Column, upper: Column, lower_inclusive: Column | bool = True, upper_inclusive: Column | bool = True) -> Column:
    flag = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lower.cast("double").alias("lower"), flag(lower_inclusive).alias("lower_inclusive"), upper.cast("double").alias("upper"), flag(upper_inclusive).alias("upper_inclusive"))


def is_empty(x: Column) -> Column:
    both = x["lower"].isNotNull() & x["upper"].isNotNull()
    return both & ((x["lower"] > x["upper"]) | ((x["lower"] == x["upper"]) & ~(x["lower_inclusive"] & x["upper_inclusive"])))


def is_point(x: Column) -> Column:
    return F.coalesce((x["lower"] == x["upper"]) & x["lower_inclusive"] & x["upper_inclusive"], F.lit(False))


def covers_lower(outer: Column, inner: Column) -> Column:
    return (
        F.when(outer["lower"].isNull(), True)
        .when(inner["lower"].isNull(), False)
        .when(outer["lower"] == inner["lower"], outer["lower_inclusive"] | ~inner["lower_inclusive"])
        .otherwise(outer["lower"] < inner["lower"])
    )


def covers_upper(outer: Column, inner: Column) -> Column:
    return (
        F.when(outer["upper"].isNull(), True)
        .when(inner["upper"].isNull(), False)
        .when(outer["upper"] == inner["upper"], outer["upper_inclusive"] | ~inner["upper_inclusive"])
        .otherwise(outer["upper"] > inner["upper"])
    )


def coverage(outer: Column, inner: Column) -> Column:
    """struct(holds, lower_holds, upper_holds, lower_mismatch, upper_mismatch): mismatches are ends that
    are equal in value and fail by openness."""
    low, high = covers_lower(outer, inner), covers_upper(outer, inner)
    mismatch = lambda end, ok: F.coalesce((outer[end] == inner[end]) & ~ok, F.lit(False))
    return F.struct((low & high).alias("holds"), low.alias("lower_holds"), high.alias("upper_holds"), mismatch("lower", low).alias("lower_mismatch"), mismatch("upper", high).alias("upper_mismatch"))


def contains_point(region: Column, point: Column) -> Column:
    low = F.when(region["lower"].isNull(), True).when(point == region["lower"], region["lower_inclusive"]).otherwise(point > region["lower"])
    high = F.when(region["upper"].isNull(), True).when(point == region["upper"], region["upper_inclusive"]).otherwise(point < region["upper"])
    return low & high


def deltas(requirement: Column, actual: Column) -> tuple[Column, Column]:
    """Signed room at both ends: actual - requirement below, requirement - actual above."""
    return actual["lower"] - requirement["lower"], requirement["upper"] - actual["upper"]


def judgement(applicable: Column, holds: Column) -> tuple[Column, Column]:
    """(state, satisfied): satisfied is null unless the comparison could be made by machine."""
    state = F.when(~F.coalesce(applicable, F.lit(False)) | holds.isNull(), "needs_confirmation").when(holds, "satisfied").otherwise("not_satisfied")
    satisfied = F.when(state == "satisfied", True).when(state == "not_satisfied", False)
    return state, satisfied


def structure_reason(kind: Column, x: Column, options: Column | None = None, most_options: int = 16) -> Column:
    """Null for a sound quantity, else the first reason against it."""
    finite = lambda v: v.isNull() | (~F.isnan(v) & (F.abs(v) < float("inf")))
    checks = F.when(kind.isNull() | ~kind.isin("interval", "alternatives"), "unknown_kind")
    ends = F.when(~finite(x["lower"]) | ~finite(x["upper"]), "non_finite").when(x["lower"].isNull() & x["upper"].isNull(), "no_bounds").when(is_empty(x), "empty_interval")
    if options is None:
        return checks.when(kind == "interval", ends)
    alternatives = F.when(F.size(options) < 1, "no_options").when(F.size(options) > most_options, "too_many_options").when(F.exists(options, lambda v: ~finite(v) | v.isNull()), "non_finite").when(F.size(F.array_distinct(options)) < F.size(options), "repeated_options")
    return checks.when(kind == "interval", ends).otherwise(alternatives)


def conversion_kind(requirement_dimension: Column, actual_dimension: Column, requirement_unit: Column, actual_unit: Column, requirement_scale: Column, actual_scale: Column) -> Column:
    return (
        F.when(~requirement_dimension.eqNullSafe(actual_dimension), "inconsistent")
        .when(requirement_unit == actual_unit, "identity")
        .when(requirement_scale.isNotNull() & actual_scale.isNotNull(), "linear")
        .otherwise("unsupported")
    )


def converted(value: Column, factor: Column, offset: Column | float = 0.0) -> Column:
    """struct(value, problem) of an affine map; a problem is a non-finite result or one that collapses to 0."""
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    out = value * factor + offset
    problem = F.when(F.isnan(out) | (F.abs(out) == float("inf")), "non_finite").when((out == offset) & (value != 0), "precision_lost")
    return F.struct(F.when(problem.isNull(), out).alias("value"), problem.alias("problem"))
