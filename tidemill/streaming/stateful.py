"""Keyed state with a time to live, and the form of state keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Rows carried through state as text keep their microseconds.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def state_key(*keys: Column) -> Column:
    """The keys as one text that is never null: state of null keys must not meet that of others."""
    return F.to_json(F.struct(*keys), JSON_TIMES)


class _CountWithTtl(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", "n bigint, total double", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, total = self.state.get() if self.state.exists() else (0, None)
        for batch in rows:
            n += int(batch["n"].sum())
            known = batch["total"].dropna()
            if len(known):
                total = (total or 0.0) + float(known.sum())
        self.state.update((n, total))
        yield pd.DataFrame({"state_key": [key[0]], "n": [n], "total": [total]}).astype({"total": "float64"})

    def close(self) -> None:
        pass


def totals_with_ttl(df: DataFrame, keys: Sequence[str], value: str, ttl_ms: int) -> DataFrame:
    """Running count and sum per key; a key's state goes ``ttl_ms`` after its last write.

    Update mode. Rows are summed per Arrow batch where they are read, so that a
    hot key sends a row per batch to its state, not a row per event. Processing-time state keeps a
    query busy on empty batches: with ``availableNow`` switch
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    if ttl_ms <= 0:
        raise ValueError("the TTL must be positive")
    out = "state_key string, n long, total double"

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups = batch.groupby("state_key", sort=False)["value"]
            yield pd.DataFrame({"n": groups.size(), "total": groups.sum(min_count=1)}).reset_index()

    rows = df.select(state_key(*[F.col(k) for k in keys]).alias("state_key"), F.col(value).cast("double").alias("value"))
    totals = rows.mapInPandas(combine, out).groupBy("state_key")
    counted = totals.transformWithStateInPandas(_CountWithTtl(ttl_ms), out, "update", "ProcessingTime")
    kinds = T.StructType([df.schema[k] for k in keys])
    return counted.select(F.from_json("state_key", kinds, JSON_TIMES).alias("k"), "n", F.nanvl("total", F.lit(None).cast("double")).alias("total")).select(
        "k.*", "n", "total"
    )
