"""Conditional functions with streaming-SQL semantics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _any_null(columns: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in columns])


def greatest(*columns: Column) -> Column:
    """NULL when any argument is NULL (Spark skips NULLs)."""
    return F.when(~_any_null(columns), F.greatest(*columns))


def least(*columns: Column) -> Column:
    return F.when(~_any_null(columns), F.least(*columns))


def if_(cond: Column, yes: Column, no: Column) -> Column:
    """``no`` also when the condition is NULL."""
    return F.when(cond, yes).otherwise(no)


def simple_case(value: Column, branches: dict, otherwise=None) -> Column:
    """``CASE value WHEN … THEN … ELSE … END``."""
    out = F.lit(otherwise)
    for match, result in reversed(list(branches.items())):
        out = F.when(value == F.lit(match), F.lit(result)).otherwise(out)
    return out


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / NULLIF(denominator, 0)``."""
    return numerator / F.nullif(denominator, F.lit(0))
