"""Row pattern matching on streams, with the pattern rules of ``operators.patterns``."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.operators.patterns import Pattern, find_matches, followers, pattern_regex, row_code, row_mask, variable_bits
from tidemill.streaming.stateful import JSON_TIMES, state_key

_ROW = "us bigint, tie bigint, mask int, body string"


class _Match(StatefulProcessor):
    """Rows wait until the watermark passes them, then extend the open run of their key.

    A run closes when its last row cannot be followed by the next one (or by
    anything); its matches are then final and are emitted. State per key: rows
    ahead of the watermark, and the open run.
    """

    def __init__(self, pattern: Pattern, within_us: int | None):
        self.names = [name for name, _ in pattern]
        self.regex, self.within_us = pattern_regex(pattern), within_us
        bits = variable_bits(pattern)
        self.next_bits = [(bits[a], sum(bits[b] for b in after)) for a, after in followers(pattern).items()]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.open = handle.getListState("open", _ROW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for batch in rows for r in batch[["row_us", "tie", "mask", "body"]].values.tolist()]
        self.waiting.appendList(new)
        self.handle.registerTimer(max(-(-min(new)[0] // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        final = [r for r in rows if r[0] <= now_us]
        if not final:  # seen to by an earlier timer
            return
        run = list(self.open.get()) if self.open.exists() else []
        out: list[str] = []
        for row in final:
            if run and not (self._reach(run[-1][2]) & row[2] and self._near(run[-1], row)):
                out += self._matches(run)
                run = []
            if row[2]:
                run.append(row)
                if not self._reach(row[2]):
                    out += self._matches(run)
                    run = []
        self._store(self.open, run)
        rest = rows[len(final) :]
        self._store(self.waiting, rest)
        if rest:
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "match": out})

    def _reach(self, mask: int) -> int:
        """The variables that may stand after a row with these ones."""
        total = 0
        for bit, after in self.next_bits:
            if mask & bit:
                total |= after
        return total

    def _near(self, a, b) -> bool:
        return self.within_us is None or b[0] - a[0] <= self.within_us

    def _matches(self, run) -> list[str]:
        out = []
        text, times = "".join(row_code(r[2]) for r in run), [r[0] for r in run]
        for start, *spans in find_matches(self.regex, text, times, self.within_us):
            labels = [name for name, n in zip(self.names, spans) for _ in range(n)]
            parts = [f'{{"variable":"{name}","row":{run[start + i][3]}}}' for i, name in enumerate(labels)]
            out.append("[" + ",".join(parts) + "]")
        return out

    @staticmethod
    def _store(state, rows) -> None:
        if rows:
            state.put(rows)
        elif state.exists():
            state.clear()

    def close(self) -> None:
        pass


def stream_match_rows(
    df: DataFrame,
    key: str,
    order: str,
    tie: str,
    pattern: Pattern,
    define: Mapping[str, Column],
    delay_ms: int,
    within_ms: int | None = None,
) -> DataFrame:
    """``match_rows`` for a stream with one key column: columns ``key`` and ``match``.

    Conditions are evaluated on single rows before the state (no lookback). A
    match is emitted when the watermark has passed it and no later row can
    extend it.
    """
    at = F.col(order).cast("timestamp")
    rows = df.select(
        state_key(F.col(key).alias("k")).alias("key"),
        at.alias("at"),
        F.unix_micros(at).alias("row_us"),
        F.col(tie).cast("long").alias("tie"),
        row_mask(pattern, define).alias("mask"),
        F.to_json(F.struct(*df.columns), JSON_TIMES).alias("body"),
    )
    out = T.StructType([T.StructField("key", T.StringType()), T.StructField("match", T.StringType())])
    found = (
        rows.withWatermark("at", f"{delay_ms} milliseconds")
        .groupBy("key")
        .transformWithStateInPandas(
            _Match(list(pattern), within_ms * 1000 if within_ms is not None else None), out, "append", "EventTime"
        )
    )
    kind = T.ArrayType(
        T.StructType([T.StructField("variable", T.StringType()), T.StructField("row", df.schema)])
    )
    own = F.from_json("key", T.StructType([T.StructField("k", df.schema[key].dataType)]), JSON_TIMES)
    return found.select(own["k"].alias(key), F.from_json("match", kind, JSON_TIMES).alias("match"))
