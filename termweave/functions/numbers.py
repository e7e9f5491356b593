"""Numeric Columns that give the same result whatever the session's ANSI setting is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends of 32-bit and 64-bit integers.
INT_MIN, INT_MAX = -(2**31), 2**31 - 1
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def long_(n: int) -> Column:
    return F.lit(n).cast("long")


def to_long(x: Column) -> Column:
    """A double without its fraction; NaN and null are 0, and what is out of range becomes the nearest end."""
    edge = float(2**63)
    return F.when(x.isNull() | F.isnan(x), long_(0)).when(x >= edge, long_(LONG_MAX)).when(x <= -edge, long_(LONG_MIN)).otherwise(x.cast("long"))


def clamp_int(x: Column) -> Column:
    return F.least(F.greatest(x.cast("long"), long_(INT_MIN)), long_(INT_MAX)).cast("int")


def wrap_int(x: Column) -> Column:
    """The low 32 bits of a long, as the integer with these bits."""
    return F.shiftright(F.shiftleft(x, 32), 32)


def divide(a: Column, b: Column) -> Column:
    """Whole part of a / b; 0 if b is 0. The one quotient out of range, -2**63 / -1, wraps around."""
    return F.when(b == 0, long_(0)).when((b == -1) & (a == LONG_MIN), long_(LONG_MIN)).otherwise(F.call_function("div", a, b))


def remainder(a: Column, b: Column) -> Column:
    """With the sign of a; an error if b is 0."""
    return F.when(b == 0, F.raise_error(F.lit("remainder of a division by 0"))).otherwise(F.try_mod(a, b))


def log(x: Column) -> Column:
    """Natural logarithm of a double with its limits: minus infinity at 0, NaN below."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def log1pexp(x: Column) -> Column:
    """log(1 + e**x) without overflow."""
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))
