"""Scalar and aggregate expressions with the semantics that the marts need."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Day names, Sunday first, and dayparts as (name, first hour, last hour); other hours are "overnight".
DAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
DAYPARTS = [("morning_peak", 6, 9), ("midday", 10, 15), ("evening_peak", 16, 19), ("evening", 20, 23)]


#: Microseconds.
SECOND_US, HOUR_US, DAY_US = 1_000_000, 3_600_000_000, 86_400_000_000


def units(us: Column, length: int) -> Column:
    """Whole units of ``length`` microseconds since 1970; exact, as microseconds of some centuries fit a double."""
    return F.floor(us / F.lit(float(length)))


def seconds_between(start_us: Column, end_us: Column) -> Column:
    """Second boundaries crossed from ``start_us`` to ``end_us`` (microseconds): 0.9 s to 1.1 s counts as one."""
    return units(end_us, SECOND_US) - units(start_us, SECOND_US)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is 0 or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def daypart(hour: Column) -> Column:
    out = None
    for name, first, last in DAYPARTS:
        out = (F if out is None else out).when(hour.between(first, last), name)
    return out.otherwise("overnight")


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position in a cycle."""
    angle = 2 * math.pi * value / period
    return F.sin(angle), F.cos(angle)


def truncated(value: Column) -> Column:
    """Towards zero, as an integer."""
    return value.cast("bigint")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, half away from zero. Sums of doubles depend on their order in the last bits, so values are first cut to
    two more digits: a mean of few amounts that ends in an exact 5 is one then, whatever the order."""
    return df.select(*(F.round(F.round(F.col(name), digits + 2), digits).alias(name) if kind == "double" else F.col(name) for name, kind in df.dtypes))
