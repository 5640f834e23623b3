"""Watermarks, late rows and deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.ordered import DEFAULT_SKEW, Ordered, Skew

DEFAULT_DELAY_MS = 5000


def bounded_out_of_orderness(df: DataFrame, ts: str, delay_ms: int = DEFAULT_DELAY_MS, lateness_ms: int = 0) -> DataFrame:
    """Watermark ``max(ts) - delay``; ``lateness_ms`` keeps windows open longer for late rows.

    With an allowed lateness run the query in update mode: a window is then
    reported again whenever a late row changes it.
    """
    zoned = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return zoned.withWatermark(ts, f"{delay_ms + lateness_ms} milliseconds")


def monotonously_increasing(df: DataFrame, ts: str) -> DataFrame:
    """Watermark equal to the largest time seen."""
    return bounded_out_of_orderness(df, ts, 0)


def deduplicate(df: DataFrame, keys: Sequence[str], ts: str, within_ms: int) -> DataFrame:
    """Each key once among rows whose times lie within the given span; state is dropped after it."""
    return bounded_out_of_orderness(df, ts, within_ms).dropDuplicatesWithinWatermark(list(keys))


def with_current_watermark(
    df: DataFrame, ts: str, partition: Sequence[str], offset: str, delay_ms: int = DEFAULT_DELAY_MS, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """CURRENT_WATERMARK on replayed rows: event-time progress of each source partition up to a row.

    The progress is that of the rows read before, in offset order; null at the start.
    """
    line = Ordered(df, partition, offset, skew=skew)
    seen = line.running({"_top": ("max", F.col(ts))}, current=False)
    return seen.withColumn("current_watermark", F.col("_top") - F.expr(f"interval {delay_ms} milliseconds")).drop("_top")


def split_late(
    df: DataFrame, ts: str, partition: Sequence[str], offset: str, delay_ms: int = DEFAULT_DELAY_MS
) -> tuple[DataFrame, DataFrame]:
    """Rows on time, and rows behind the watermark for a side output (batch replay of a topic)."""
    marked = with_current_watermark(df, ts, partition, offset, delay_ms)
    late = F.coalesce(F.col(ts) < F.col("current_watermark"), F.lit(False))
    return marked.where(~late), marked.where(late)


def distinct_per_window(
    df: DataFrame, ts: str, size: str, keys: Sequence[str], value: str, name: str, delay_ms: int = DEFAULT_DELAY_MS, slide: str | None = None
) -> DataFrame:
    """Exact ``COUNT(DISTINCT value)`` per window and key on a stream, in append mode.

    A value is handed on when a window sees it first; the window counts what it is
    handed. State holds a value once per open window, and both go when the
    watermark passes the window's end. A null value makes a window but counts
    nothing.
    """
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    first = bounded_out_of_orderness(df, ts, delay_ms).select(window.alias("_w"), *keys, F.col(value).alias("_v")).dropDuplicates(["_w", *keys, "_v"])
    counted = first.groupBy("_w", *keys).agg(F.count("_v").alias(name))
    return counted.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), name)
