"""Rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(value: Column) -> Column:
    """NULL-safe: NULL counts as not finite. Spark orders NaN above every number, so bounds alone do not exclude it."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), F.lit(False))


def tenth_ms(seconds: Column) -> Column:
    """Milliseconds to one decimal, halves up."""
    return F.floor(seconds * 10000 + 0.5).cast("double") / 10


def third_decimal_ms(seconds: Column) -> Column:
    return F.round(seconds * 1000, 3)


def fixed_text(value: Column, digits: int) -> Column:
    """The value with 0 or 1 digits after the point, rounded half to even on the exact binary value.

    Twice the scaled value is held as a sum of two doubles without any error, so a tie is told from a value beside it:
    12.25 gives 12.2, while 0.35, which is a little less than it reads, gives 0.3.
    """
    x = F.abs(value.cast("double"))
    if digits == 0:
        twice, rest = x * 2, F.lit(0.0)
    else:
        a, b = x * 16, x * 4
        twice = a + b
        part = twice - a
        rest = (a - (twice - part)) + (b - part)
    whole = F.floor(twice / 2)
    above = (twice - 2 * whole.cast("double") - 1) + rest
    up = (above > 0) | ((above == 0) & (whole % 2 == 1))
    units = whole + F.when(up, 1).otherwise(0)
    sign = F.when((value < 0), F.lit("-")).otherwise("")
    text = units.cast("string") if digits == 0 else F.concat(F.floor(units / 10).cast("string"), F.lit("."), (units % 10).cast("string"))
    return F.concat(sign, text)
