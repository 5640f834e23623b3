"""Size checks behind every choice between a small-data and a large-data plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemill.session import reliable_checkpoint


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate (the figure ``EXPLAIN COST`` prints); runs no job.

    Without table statistics it starts from file sizes and does not shrink for
    filters, so it errs on the large side for scans, filters and aggregates.
    """
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def at_most(df: DataFrame, limit: int) -> bool:
    return estimated_bytes(df) <= limit


def settle(df: DataFrame, above: int = 64 << 20) -> DataFrame:
    """A large intermediate result written to the shared folder, a small one left as it is.

    For results that the next step reads more than once: they are computed once,
    and an executor lost later does not bring the work before them back.
    """
    return df if at_most(df, above) else reliable_checkpoint(df)
