"""Numeric functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(c: Column, places: int = 0) -> Column:
    """Cuts digits after ``places`` toward zero, deciding on the decimal form of the number.

    A double of 2**53 or more has no fraction; with ``places`` of 0 or more it
    stays as it is. Digits past the 22nd are not looked at.
    """
    number = c.cast("double")
    whole = F.abs(number) >= float(1 << 53)
    exact = F.when(~whole, number).cast("decimal(38,22)")
    cut = F.when(exact < 0, F.ceil(exact, F.lit(places))).otherwise(F.floor(exact, F.lit(places)))
    power = float(10 ** max(-places, 0))
    large = number if places >= 0 else F.signum(number) * F.floor(F.abs(number) / power).cast("double") * power
    return F.when(whole, large).otherwise(cut.cast("double"))


def _logarithm(fn, c: Column) -> Column:
    return F.when(c > 0, fn(c)).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan")))


def log2(c: Column) -> Column:
    """-Infinity for 0 and NaN below it (Spark gives NULL)."""
    return _logarithm(F.log2, c.cast("double"))


def log10(c: Column) -> Column:
    return _logarithm(F.log10, c.cast("double"))


def rand_integer(bound: int, seed: int | None = None) -> Column:
    """Uniform over ``0 .. bound - 1``."""
    r = F.rand(seed) if seed is not None else F.rand()
    return F.floor(r * bound).cast("int")


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return a % b
