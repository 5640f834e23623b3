"""Sending rows to one of several outputs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_error_reason(df: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """Adds ``error_reason``: the first reason, in the given order, whose condition holds."""
    first = F.lit(None).cast("string")
    for reason, broken in reversed(list(reasons.items())):
        first = F.when(broken, reason).otherwise(first)
    return df.withColumn("error_reason", first)


def split_valid(
    df: DataFrame, reasons: Mapping[str, Column], failed_at: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and dead letters with reason and time. Both are filters on one marked frame."""
    marked = with_error_reason(df, reasons)
    valid = marked.where(F.col("error_reason").isNull()).drop("error_reason")
    dead = marked.where(F.col("error_reason").isNotNull()).withColumn(
        "failed_at", failed_at if failed_at is not None else F.current_timestamp()
    )
    return valid, dead


def merge_retries(
    fresh: DataFrame, retry: DataFrame, max_retries: int, count: str = "retry_count"
) -> tuple[DataFrame, DataFrame]:
    """Fresh rows (count 0) with retried ones (count + 1); rows out of attempts come second."""
    tried = F.coalesce(F.col(count), F.lit(0))
    again = retry.where(tried < max_retries).withColumn(count, tried + 1)
    spent = retry.where(tried >= max_retries)
    return fresh.withColumn(count, F.lit(0)).unionByName(again, allowMissingColumns=True), spent


def bucket_of(key: Column, buckets: int = 100, hash_fn: Callable[[Column], Column] = F.xxhash64) -> Column:
    """A stable bucket number for a key; equal keys always share one."""
    return F.pmod(hash_fn(key), F.lit(buckets))


def md5_number(key: Column) -> Column:
    """A hash other systems can reproduce: the first eight hex digits of MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def route_percentage(
    df: DataFrame, key: str, percent: Column, hash_fn: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """Adds ``route``: ``canary`` for the given share of the keys, ``stable`` for the rest."""
    chosen = bucket_of(F.col(key), 100, hash_fn) < percent
    return df.withColumn("route", F.when(chosen, "canary").otherwise("stable"))
