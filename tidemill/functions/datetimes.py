"""Date and time functions. Stored event time carries no zone; text is read as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_timestamp(c: Column, fmt: str | None = None) -> Column:
    """NULL for text that is no timestamp."""
    parsed = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    return parsed.cast("timestamp_ntz")


def to_timestamp_ltz(n: Column, precision: int) -> Column:
    """Epoch seconds (precision 0) or milliseconds (precision 3)."""
    if precision not in (0, 3):
        raise ValueError("precision is 0 or 3")
    return F.timestamp_seconds(n) if precision == 0 else F.timestamp_millis(n)


def to_date(c: Column, fmt: str | None = None) -> Column:
    return F.try_to_date(c, fmt) if fmt else F.try_to_date(c)


def convert_tz(c: Column, source: str, target: str) -> Column:
    """Wall-clock text of one zone as wall-clock text of another."""
    at = F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return F.date_format(F.convert_timezone(F.lit(source), F.lit(target), at), "yyyy-MM-dd HH:mm:ss")


def extract(unit: str, c: Column) -> Column:
    """A field as a whole number; MILLISECOND and MICROSECOND count within the second."""
    unit = unit.upper()
    if unit in ("MILLISECOND", "MICROSECOND"):
        scale = 1_000 if unit == "MILLISECOND" else 1_000_000
        whole = F.extract(F.lit("SECOND"), c) * scale
        return F.floor(whole).cast("long") % scale
    return F.floor(F.extract(F.lit(unit), c)).cast("long")


def timestampadd(unit: str, n: Column, c: Column) -> Column:
    return F.timestamp_add(unit, n, c)


def timestampdiff(unit: str, start: Column, end: Column) -> Column:
    """Whole units from start to end, truncated toward zero."""
    return F.timestamp_diff(unit, start, end)


def older_than(c: Column, as_of: Column, interval: str) -> Column:
    """``c < as_of - INTERVAL``: the relative-time filter with an explicit clock."""
    return c < as_of - F.expr(f"interval {interval}")
