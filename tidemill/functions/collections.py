"""Array and map functions with streaming-SQL semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def element(a: Column) -> Column:
    """The only element; NULL for an empty array; an error for more than one."""
    return F.when(
        F.size(a) > 1, F.raise_error(F.lit("ELEMENT needs at most one element"))
    ).otherwise(F.get(a, F.lit(0)))


def array_slice(a: Column, start: int, end: int) -> Column:
    """Elements ``start`` to ``end``, both included and counted from 1."""
    return F.slice(a, start, max(end - start + 1, 0))


def array_position(a: Column, value) -> Column:
    """From 1; 0 when absent."""
    return F.array_position(a, value).cast("int")


def at(c: Column, key) -> Column:
    """``a[i]`` (from 1) or ``m[key]``; NULL when absent."""
    return F.try_element_at(c, key if isinstance(key, Column) else F.lit(key))


def map_union(*maps: Column) -> Column:
    """Entries of all maps; for a repeated key the last map wins."""

    def without(m: Column, other: Column) -> Column:
        return F.map_filter(m, lambda k, _: ~F.map_contains_key(other, k))

    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(without(out, m), m)
    return out
