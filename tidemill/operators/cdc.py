"""Change data: unwrapping, current state, validity intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.ordered import DEFAULT_SKEW, Ordered, Skew


def unwrap_changes(df: DataFrame, payload: str, row_schema: str) -> DataFrame:
    """Change envelopes (``op``, ``before``, ``after``, ``ts_ms``) to plain rows with ``__deleted``.

    A delete carries its last image in ``before``; every other operation
    carries the new one in ``after``. ``r`` marks rows of the first snapshot.
    """
    envelope = f"op string, before struct<{row_schema}>, after struct<{row_schema}>, ts_ms bigint"
    e = F.from_json(F.col(payload), envelope, {"mode": "PERMISSIVE"})
    return (
        df.withColumn("_e", e)
        .where(F.col("_e.op").isNotNull())
        .withColumn("_row", F.coalesce("_e.after", "_e.before"))
        .select(
            "_row.*",
            F.col("_e.op").alias("__op"),
            F.timestamp_millis("_e.ts_ms").cast("timestamp_ntz").alias("__changed_at"),
            (F.col("_e.op") == "d").alias("__deleted"),
            F.when(F.col("_e.op") == "r", "snapshot").otherwise("live").alias("__phase"),
        )
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], version: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """The newest row per key by ``version`` columns (upsert materialisation).

    A ``max_by`` aggregate keeps one row per key and task before the shuffle, so
    a key with many versions costs no more than one with few. Deletes are
    applied after the choice: a delete hides the versions before it.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row"))
    out = newest.select(*keys, "_row.*").select(*df.columns)
    return out.where(~F.coalesce(deleted, F.lit(False))) if deleted is not None else out


def earliest_per_key(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Keep-first deduplication: the oldest row per key by ``version`` columns."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*version)).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def delete_status(deleted: Column) -> Column:
    return F.when(deleted, "deleted").otherwise("active")


def validity_intervals(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str] = (), skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Versions with ``valid_from`` and an exclusive ``valid_to`` (null for the current one)."""
    line = Ordered(df, keys, ts, ties, skew=skew)
    return line.over_rows({"valid_to": lambda w: F.lead(ts).over(w)}, after=1).withColumn("valid_from", F.col(ts))


def with_defaults(df: DataFrame, **defaults) -> DataFrame:
    """Fill columns added by a schema change: missing ones are created, nulls replaced."""
    for name, value in defaults.items():
        value = value if isinstance(value, Column) else F.lit(value)
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df
