"""Rows of a stream handed on in time order, with state that is read and written by time.

Rows may come out of order within the watermark's delay. Every call into the state
is a message to the JVM, so rows go there many at a time. A key's few rows wait
together, in one value with one timer at the first of them. Beyond ``LOOSE_ROWS``
they are dealt to buckets of time, as parts that are not read again before their
time comes. A bucket is the wider the further it is ahead of the watermark, a
minute at least, so a key has few buckets, whatever time its rows span; wide ones
are cut finer once they are due. A key with many rows waiting is therefore read
and written by time, and no more than ``LOOSE_ROWS`` or a minute of it at once.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.operators.automaton import Machine, Pattern, Rules, Test
from tidemill.operators.row_patterns import row_mask
from tidemill.streaming.stateful import JSON_TIMES, state_key

BUCKET_MS = 60_000
WIDER = 64  # a bucket of the next level, in buckets
LOOSE_ROWS = 4096


class InOrder(StatefulProcessor):
    """Base: ``advance`` gets a key's next rows, in order of time, ``rank`` and ``tie``, and gives result rows."""

    def __init__(self, row: T.StructType, bucket_ms: int = BUCKET_MS, loose_rows: int = LOOSE_ROWS):
        self.row, self.bucket_ms, self.loose_rows = row, bucket_ms, loose_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "state binary")
        self.parts = handle.getMapState("parts", "level int, bucket bigint, part int", "rows binary")

    def advance(self, key, rows: list[dict]) -> Iterator[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        timer, buckets, loose = self._load()
        for row in rows:
            loose.append(tuple(row[n] for n in self.row.names))
            if len(loose) >= 2 * self.loose_rows:
                self._deal(buckets, loose, now)
                loose = []
        if len(loose) > self.loose_rows:
            self._deal(buckets, loose, now)
            loose = []
        self._save(timer, buckets, loose, now)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        _, buckets, loose = self._load()
        while True:
            due = sorted((b for b, (first, *_) in buckets.items() if first <= now), key=lambda b: (self._span(b)[0], -b[0]))
            end = self._span(due[0])[1] if due else now + 1
            group = [b for b in due if self._span(b)[0] < end]  # the widest first, with those inside it
            if sum(buckets[b][2] for b in group) > self.loose_rows and group[0][0] > 0:
                for part in self._taken(buckets, group[0]):
                    self._deal(buckets, part, now, group[0][0] - 1)
                continue
            rows = [r for b in group for part in self._taken(buckets, b) for r in part]
            rows += [r for r in loose if r[0] <= (end - 1) * 1000]
            rows.sort(key=lambda r: r[:3])
            n = bisect_right(rows, now * 1000, key=lambda r: r[0])
            loose = rows[n:] + [r for r in loose if r[0] > (end - 1) * 1000]
            if n:
                names = self.row.names
                out = list(self.advance(key, [dict(zip(names, r, strict=True)) for r in rows[:n]]))
                if out:
                    yield Row(rows=pickle.dumps(out, pickle.HIGHEST_PROTOCOL))
            if not due:
                break
        if len(loose) > self.loose_rows:
            self._deal(buckets, loose, now)
            loose = []
        self._save(None, buckets, loose, now)

    def _load(self) -> tuple[int | None, dict, list[tuple]]:
        """The time of the key's timer; its buckets, ``(level, number): [first ms, parts, rows]``; its rows in no bucket."""
        return pickle.loads(self.waiting.get()[0]) if self.waiting.exists() else (None, {}, [])

    def _save(self, timer: int | None, buckets: dict, loose: list[tuple], now: int) -> None:
        """The state, and its timer unless the one that is set will do; a late row goes with the next."""
        first = [f for f, *_ in buckets.values()]
        if loose:
            first.append(-(-min(r[0] for r in loose) // 1000))
        if not first:
            self.waiting.clear()
            return
        at = max(min(first), now + 1)
        if timer is None or timer > at:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
            timer = at
        self.waiting.update((pickle.dumps((timer, buckets, loose), pickle.HIGHEST_PROTOCOL),))

    def _span(self, bucket: tuple[int, int]) -> tuple[int, int]:
        width = self.bucket_ms * WIDER ** bucket[0]
        return bucket[1] * width, (bucket[1] + 1) * width

    def _deal(self, buckets: dict, rows: list[tuple], now: int, level: int | None = None) -> None:
        """Rows to the buckets of their times, as new parts: of one level, or by how far ahead they are."""
        dealt: dict[tuple, list] = {}
        for row in rows:
            at, own = -(-row[0] // 1000), level
            if own is None:
                own = 0
                while at - now >= self.bucket_ms * WIDER ** (own + 1):
                    own += 1
            dealt.setdefault((own, at // (self.bucket_ms * WIDER**own)), []).append(row)
        for bucket, own in dealt.items():
            first, parts, n = buckets.get(bucket, (None, 0, 0))
            at = -(-min(r[0] for r in own) // 1000)
            self.parts.updateValue((*bucket, parts), (pickle.dumps(own, pickle.HIGHEST_PROTOCOL),))
            buckets[bucket] = (at if first is None else min(first, at), parts + 1, n + len(own))

    def _taken(self, buckets: dict, bucket: tuple[int, int]) -> Iterator[list[tuple]]:
        """The parts of a bucket, which are gone then."""
        for part in range(buckets.pop(bucket)[1]):
            yield pickle.loads(self.parts.getValue((*bucket, part))[0])
            self.parts.removeKey((*bucket, part))

    def close(self) -> None:
        pass


def _stored(schema: T.StructType, names: Sequence[str]) -> dict[str, Column]:
    """Columns as state keeps them: zoned times as microseconds, all else as it is."""
    zoned = lambda n: isinstance(schema[n].dataType, T.TimestampType)
    return {n: F.unix_micros(n) if zoned(n) else F.col(n) for n in names}


def _restored(kind: T.DataType, column: Column) -> Column:
    return F.timestamp_micros(column) if isinstance(kind, T.TimestampType) else column


def _kept(kind: T.DataType) -> T.DataType:
    return T.LongType() if isinstance(kind, T.TimestampType) else kind


def _line(df: DataFrame, key: Column, order: str, rank: Column, tie: Column, columns: Mapping[str, Column]) -> DataFrame:
    """What every processor here reads: the key, the time, the place among equal times, and the row's columns."""
    at = F.col(order).cast("timestamp")
    return df.select(
        state_key(key.alias("k")).alias("key"),
        F.unix_micros(at).alias("us"),
        rank.cast("int").alias("rank"),
        tie.cast("long").alias("tie"),
        *[c.alias(n) for n, c in columns.items()],
        at.alias("at"),
    )


def _through(line: DataFrame, delay_ms: int, processor: type[InOrder], out: T.StructType, *args) -> DataFrame:
    """``line`` through a processor, whose rows the watermark, ``delay_ms`` behind, lets pass."""
    row = T.StructType([f for f in line.schema.fields if f.name != "key"])
    row = T.StructType([T.StructField(f.name, _kept(f.dataType)) for f in row.fields if f.name != "at"])
    watched = line.withWatermark("at", f"{delay_ms} milliseconds")
    # The Python worker holds all that a task's timers give, one dictionary a row; packed, that is a few bytes a row.
    packed = watched.groupBy("key").transformWithState(processor(row, *args), "rows binary", "append", "EventTime")
    unpacked = F.udf(pickle.loads, T.ArrayType(out), useArrow=False)
    return packed.select(F.inline(unpacked("rows")))


# -- patterns -----------------------------------------------------------------------
class _Match(InOrder):
    """A key's automaton: what is kept is its state, not the rows of the matches that are open."""

    def __init__(self, row: T.StructType, rules: Rules):
        super().__init__(row)
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "state binary")

    def advance(self, key, rows: list[dict]) -> Iterator[tuple]:
        machine, position = Machine(self.rules), 0
        if self.open.exists():
            machine.epoch, machine.starts, position = pickle.loads(self.open.get()[0])
        for row in rows:
            position += 1
            machine.step(position, row["mask"], row)
            for _, match in machine.take():
                yield (key[0], *match.measures)
        if not machine.starts:
            machine.epoch = 0
        self.open.update((pickle.dumps((machine.epoch, machine.starts, position)),))


def stream_match(
    df: DataFrame,
    key: str,
    order: str,
    tie: str,
    pattern: Pattern,
    define: Mapping[str, Column | Test],
    measures: Mapping[str, tuple[str, str | None, str]],
    delay_ms: int,
) -> DataFrame:
    """One row per match on a stream: the key and the measures.

    ``define`` is that of ``matched_rows``: columns over single rows, or ``Test``s
    that refer to rows matched before; for ``price > LAST(price)`` refer to
    ``Ref(None, "price")``. ``measures`` is ``{name: (kind, variable, field)}``
    with kind ``first``, ``last``, ``sum``, ``min``, ``max`` or ``count``, and
    None for any variable. A match leaves when the watermark has passed the row
    that decides it; one that later rows might still extend waits for them.
    """
    rules = Rules(pattern, {n: t for n, t in define.items() if isinstance(t, Test)}, list(measures.values()))
    columns = {"mask": row_mask(rules, define), **_stored(df.schema, rules.fields)}
    line = _line(df, F.col(key), order, F.lit(0), F.col(tie), columns)

    def kind(measure: tuple[str, str | None, str]) -> T.DataType:
        if measure[0] == "count":
            return T.LongType()
        own = df.schema[measure[2]].dataType
        if measure[0] != "sum":
            return own
        return own if isinstance(own, T.DecimalType) else T.LongType() if isinstance(own, T.IntegralType) else T.DoubleType()

    kinds = {name: kind(m) for name, m in measures.items()}
    out = T.StructType([T.StructField("key", T.StringType()), *[T.StructField(n, _kept(k)) for n, k in kinds.items()]])
    found = _through(line, delay_ms, _Match, out, rules)
    own = F.from_json("key", T.StructType([T.StructField("k", df.schema[key].dataType)]), JSON_TIMES)
    return found.select(own["k"].alias(key), *[_restored(k, F.col(n)).alias(n) for n, k in kinds.items()])


# -- as-of join -----------------------------------------------------------------------
_PROBE, _VERSION = "p_", "v_"


class _AsOf(InOrder):
    """Rank 0 are versions, rank 1 probes: on one time line the newest version so far is all that is kept."""

    def __init__(self, row: T.StructType, how: str, probe: Sequence[str], version: Sequence[str]):
        super().__init__(row)
        self.how, self.probe, self.version = how, list(probe), list(version)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        kept = [self.row[n] for n in ("us", "tie", *self.version)]
        self.newest = handle.getValueState("newest", T.StructType(kept))

    def advance(self, key, rows: list[dict]) -> Iterator[tuple]:
        newest = before = tuple(self.newest.get()) if self.newest.exists() else None
        for row in rows:
            if row["rank"] == 0:
                version = (row["us"], row["tie"], *[row[n] for n in self.version])
                if newest is None or version[:2] >= newest[:2]:
                    newest = version
                continue
            found = newest is not None and newest[0] <= row["us"]
            if found or self.how == "left":
                values = newest[2:] if found else [None] * len(self.version)
                yield (*[row[n] for n in self.probe], *values)
        if newest is not before:
            self.newest.update(newest)


def stream_as_of_join(
    probes: DataFrame,
    versions: DataFrame,
    key: tuple[str, str],
    probe_ts: str,
    version_ts: str,
    columns: Sequence[str],
    sequence: str,
    delay_ms: int,
    how: str = "left",
) -> DataFrame:
    """As-of join of two streams: each probe with the version of its key valid at its time.

    A probe waits until the watermark passes its time, so a version that arrives
    late but within ``delay_ms`` is still found. Of versions with one time the
    last by ``sequence`` counts. A null key has no version.
    """
    probe = {f"{_PROBE}{n}": (probes.schema[n].dataType, c) for n, c in _stored(probes.schema, probes.columns).items()}
    version = {f"{_VERSION}{n}": (versions.schema[n].dataType, c) for n, c in _stored(versions.schema, columns).items()}

    def side(df: DataFrame, rank: int, k: str, ts: str, seq: Column, own: dict) -> DataFrame:
        all_ = {n: own[n][1] if n in own else F.lit(None).cast(_kept(t)) for n, (t, _) in {**probe, **version}.items()}
        return _line(df, F.col(k), ts, F.lit(rank), seq, all_)

    line = side(probes, 1, key[0], probe_ts, F.lit(0), probe).unionByName(
        side(versions.where(F.col(key[1]).isNotNull()), 0, key[1], version_ts, F.col(sequence), version)
    )
    out = T.StructType([T.StructField(n, _kept(t)) for n, (t, _) in {**probe, **version}.items()])
    joined = _through(line, delay_ms, _AsOf, out, how, list(probe), list(version))
    return joined.select(*[_restored(t, F.col(n)).alias(n[2:]) for n, (t, _) in {**probe, **version}.items()])


# -- neighbours -----------------------------------------------------------------------
class _Previous(InOrder):
    """Each row with the row ``offset`` before; the last ``offset`` rows are kept."""

    def __init__(self, row: T.StructType, offset: int, columns: Sequence[str]):
        super().__init__(row)
        self.offset, self.columns = offset, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        kept = T.StructType([self.row[n] for n in self.columns])
        self.last = handle.getValueState("last", T.StructType([T.StructField("rows", T.ArrayType(kept))]))

    def advance(self, key, rows: list[dict]) -> Iterator[tuple]:
        new = [tuple(r[n] for n in self.columns) for r in rows]
        seen = list(map(tuple, self.last.get()[0])) if self.last.exists() else []
        line = [None] * (self.offset - len(seen)) + seen + new
        for now, before in zip(new, line, strict=False):
            yield now, before
        self.last.update(([r for r in line[-self.offset :] if r is not None],))


def stream_lag(df: DataFrame, key: str, order: str, tie: str, delay_ms: int, offset: int = 1) -> DataFrame:
    """LAG over a stream: the columns of ``df`` and ``previous``, the row ``offset`` before it in its key.

    Each row leaves when the watermark has passed it.
    """
    names = {f"{_PROBE}{n}": (df.schema[n].dataType, c) for n, c in _stored(df.schema, df.columns).items()}
    line = _line(df, F.col(key), order, F.lit(0), F.col(tie), {n: c for n, (_, c) in names.items()})
    kept = T.StructType([T.StructField(n, _kept(t)) for n, (t, _) in names.items()])
    out = T.StructType([T.StructField("row", kept), T.StructField("previous", kept)])
    lagged = _through(line, delay_ms, _Previous, out, offset, list(names))
    whole = lambda side: [_restored(t, F.col(side)[n]).alias(n[2:]) for n, (t, _) in names.items()]
    previous = F.when(F.col("previous").isNotNull(), F.struct(*whole("previous")))
    return lagged.select(*whole("row"), previous.alias("previous"))
