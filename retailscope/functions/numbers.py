"""Numeric column builders: rounding, normalising, bucketing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, places: int = 0) -> Column:
    """Rounds half towards +infinity (``round`` rounds half away from zero)."""
    if places == 0:
        return F.floor(c + F.lit(0.5))
    scale = float(10**places)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def log_norm(c: Column, floor: float, ceiling: float) -> Column:
    """0 at or below the floor, 1 at or above the ceiling, logarithmic between."""
    span = F.ln(F.lit(float(ceiling)) / F.lit(float(floor)))
    return (
        F.when(c <= floor, F.lit(0.0))
        .when(c >= ceiling, F.lit(1.0))
        .when(c.isNotNull(), F.ln(c.cast("double") / F.lit(float(floor))) / span)
    )


def lin_norm(c: Column, floor: float, ceiling: float) -> Column:
    """0 at or below the floor, 1 at or above the ceiling, linear between."""
    return (
        F.when(c <= floor, F.lit(0.0))
        .when(c >= ceiling, F.lit(1.0))
        .when(c.isNotNull(), (c - F.lit(float(floor))) / F.lit(float(ceiling) - float(floor)))
    )


def bucket(c: Column, bounds: Sequence[tuple[float, str]], beyond: str) -> Column:
    """The label of the first upper bound that is not below the value."""
    first, *rest = bounds
    out = F.when(c <= first[0], F.lit(first[1]))
    for limit, label in rest:
        out = out.when(c <= limit, F.lit(label))
    return out.when(c.isNotNull(), F.lit(beyond))


def finite_number(c: Column) -> Column:
    """A finite double read from text or a number; anything else is null."""
    as_double = c.try_cast("double")
    return F.when(~F.isnan(as_double) & (F.abs(as_double) != F.lit(float("inf"))), as_double)


def whole_number(c: Column) -> Column:
    """A finite number rounded half up to a long."""
    return round_half_up(finite_number(c)).cast("bigint")


def months_since(start: Column, end: Column) -> Column:
    """Whole calendar months, one fewer while the day of month is not reached."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return months - F.when(F.dayofmonth(end) < F.dayofmonth(start), 1).otherwise(0)
