"""Time windows: tumbling, hopping, session and cumulating.

Row forms (``tumble``, ``hop``, ``cumulate``) add ``window_start``,
``window_end`` and ``window_time`` columns to every row. Pane forms aggregate
per small pane before anything else, so that what is shuffled is one row per
key and pane (combined on the map side), however many rows a hot key has.

Pane forms take ``aggs`` as ``{name: (partial, merge)}``, for example
``{"n": (F.count("*"), F.sum), "top": (F.max("value"), F.max)}``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Aggs = Mapping[str, tuple[Column, Callable[[Column], Column]]]


def _interval(text: str) -> Column:
    return F.expr(f"interval {text}")


#: Microseconds of the units an interval text may use here.
_UNITS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}


def micros_of(text: str) -> int:
    """The length of an interval like ``1 hour 30 minutes`` of units with a fixed length."""
    parts = re.findall(r"(-?\d+)\s*([A-Za-z]+)", text)
    if not parts or re.sub(r"(-?\d+)\s*([A-Za-z]+)", "", text).strip():
        raise ValueError(f"not an interval: {text!r}")
    try:
        return sum(int(n) * _UNITS[unit.lower().removesuffix("s")] for n, unit in parts)
    except KeyError as error:
        raise ValueError(f"a unit without a fixed length in {text!r}") from error


def _check_steps(step: str, size: str) -> None:
    if micros_of(step) <= 0 or micros_of(size) % micros_of(step):
        raise ValueError(f"the size of cumulating windows ({size}) must be a multiple of their step ({step})")


def _with_bounds(df: DataFrame, w: Column) -> DataFrame:
    return (
        df.withColumn("_w", w)
        .withColumn("window_start", F.col("_w.start"))
        .withColumn("window_end", F.col("_w.end"))
        .withColumn("window_time", F.col("window_end") - _interval("1 millisecond"))
        .drop("_w")
    )


def with_proctime(windows: DataFrame) -> DataFrame:
    """Adds ``window_proctime``, the time at which a window's result is made (on a stream, its micro-batch's)."""
    return windows.withColumn("window_proctime", F.current_timestamp())


def tumble(df: DataFrame, ts: str, size: str) -> DataFrame:
    """Fixed windows ``[start, start + size)`` aligned to the epoch."""
    return _with_bounds(df, F.window(ts, size))


def hop(df: DataFrame, ts: str, size: str, slide: str) -> DataFrame:
    """Sliding windows; each row appears once per window holding it."""
    return _with_bounds(df, F.window(ts, size, slide))


def cumulate(df: DataFrame, ts: str, step: str, size: str) -> DataFrame:
    """Growing windows that share a start; each row appears once per end at or after it.

    For aggregates that cannot be merged from panes (exact distinct counts).
    Every window from the first step with data is present per row, so grouping
    by the bounds gives the same windows as ``cumulate_panes``.
    """
    _check_steps(step, size)
    outer, pane = F.window(ts, size), F.window(ts, step)
    return (
        df.withColumn("_o", outer)
        .withColumn("_p", pane)
        .withColumn("window_start", F.col("_o.start"))
        .withColumn("window_end", F.explode(F.sequence(F.col("_p.end"), F.col("_o.end"), _interval(step))))
        .withColumn("window_time", F.col("window_end") - _interval("1 millisecond"))
        .drop("_o", "_p")
    )


def tumble_agg(df: DataFrame, ts: str, size: str, keys: Sequence[str | Column], *aggs: Column) -> DataFrame:
    """``GROUP BY TUMBLE(ts, size), keys``; the same call serves batch and stream."""
    w = F.window(ts, size)
    return (
        df.groupBy(w.alias("_w"), *keys)
        .agg(*aggs)
        .withColumn("window_start", F.col("_w.start"))
        .withColumn("window_end", F.col("_w.end"))
        .drop("_w")
    )


def hop_agg(df: DataFrame, ts: str, size: str, slide: str, keys: Sequence[str | Column], *aggs: Column) -> DataFrame:
    """``GROUP BY HOP(ts, slide, size), keys`` by plain expansion (any aggregate)."""
    return (
        df.groupBy(F.window(ts, size, slide).alias("_w"), *keys)
        .agg(*aggs)
        .withColumn("window_start", F.col("_w.start"))
        .withColumn("window_end", F.col("_w.end"))
        .drop("_w")
    )


def floor_div(x: Column, width: int) -> Column:
    """``x`` divided by ``width`` and rounded down, exact for any 64-bit number that is not near its limits."""
    return F.round((x - F.pmod(x, F.lit(width))) / width).cast("long")  # whole, whatever the rounding of the quotient


def _pane(ts: str, width: int) -> Column:
    """The number of the pane a time lies in, counted from the epoch."""
    return floor_div(F.unix_micros(F.col(ts).cast("timestamp")), width)


class _Hops:
    """Hopping windows as numbers: window ``j`` starts at ``j`` slides and holds the panes from ``first`` to ``last``."""

    def __init__(self, size: str, slide: str):
        self.size, self.slide = micros_of(size), micros_of(slide)
        if self.size <= 0 or self.slide <= 0:
            raise ValueError("size and slide must be positive")
        self.width = math.gcd(self.size, self.slide)
        self.panes = self.size // self.width  # in a window
        self.step = self.slide // self.width  # panes from a window to the next

    def earliest(self, pane: Column) -> Column:
        """The first window that holds a pane."""
        return F.floor((pane - self.panes) / self.step) + 1

    def latest(self, pane: Column) -> Column:
        return F.floor(pane / self.step)

    def bounds(self, j: Column, kind) -> list[Column]:
        start = F.timestamp_micros(j * self.slide).cast(kind)
        return [start.alias("window_start"), F.timestamp_micros(j * self.slide + self.size).cast(kind).alias("window_end")]


def hop_panes(df: DataFrame, ts: str, size: str, slide: str, keys: Sequence[str], aggs: Aggs) -> DataFrame:
    """Hopping windows from panes that divide both ``size`` and ``slide``.

    Rows are reduced to panes, combined before the shuffle. Panes are then shuffled
    by key once and sorted once, with two marks each: the first window that holds
    the pane and the first that does not. From a mark to the next all windows hold
    the same panes, so a frame over pane numbers is taken at the marks alone, and
    windows are made as the last step, which keeps none of them. Use it for mergeable
    aggregates.
    """
    hops = _Hops(size, slide)
    df.select(F.window(ts, size, slide))  # Spark's own rules for the two
    panes = (
        df.where(F.col(ts).isNotNull())
        .groupBy(_pane(ts, hops.width).alias("_pane"), *keys)
        .agg(*[partial.alias(name) for name, (partial, _) in aggs.items()])
    )
    if keys:  # before the marks are added, so that they are not shuffled
        panes = panes.repartition(*keys)
    pane = F.col("_pane")
    # A pane itself (null) and its marks, each at the last pane of its window.
    marks = F.array(F.lit(None).cast("long"), hops.earliest(pane), hops.latest(pane) + 1)
    lines = panes.withColumn("_j", F.explode(marks)).withColumn("_last", F.coalesce(F.col("_j") * hops.step + (hops.panes - 1), pane))
    by_last = Window.partitionBy(*keys).orderBy("_last")
    frame = by_last.rangeBetween(-(hops.panes - 1), 0)
    only = {name: F.when(F.col("_j").isNull(), F.col(name)) for name in aggs}
    held = F.count(F.when(F.col("_j").isNull(), 1)).over(frame).alias("_held")
    merged = lines.select(*keys, "_j", "_last", held, *[merge(only[name]).over(frame).alias(name) for name, (_, merge) in aggs.items()])
    runs = merged.where(F.col("_j").isNotNull()).withColumn("_next", F.lead("_j").over(by_last))
    windows = runs.where((F.col("_held") > 0) & (F.col("_next") > F.col("_j"))).withColumn("_j", F.explode(F.sequence("_j", F.col("_next") - 1)))
    return windows.select(*keys, *aggs, *hops.bounds(F.col("_j"), df.schema[ts].dataType))


def hop_distinct(df: DataFrame, ts: str, size: str, slide: str, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact ``COUNT(DISTINCT value)`` in hopping windows, without a copy of a row for each window.

    A value counts in a window once, whatever its occurrences, so only the gaps
    between its panes matter: an occurrence adds the value to the windows after
    the last one that an earlier occurrence reached. These are runs of windows,
    noted as +1 at their first and -1 behind their last; running sums over the
    notes of a key are the counts. A null value makes a window but counts nothing.
    """
    hops = _Hops(size, slide)
    df.select(F.window(ts, size, slide))
    seen = df.where(F.col(ts).isNotNull()).select(*keys, F.col(value).alias("_v"), _pane(ts, hops.width).alias("_pane")).distinct()
    pane = F.col("_pane")
    reached = F.lag(hops.latest(pane)).over(Window.partitionBy(*keys, "_v").orderBy("_pane"))
    first, last = F.greatest(hops.earliest(pane), reached + 1), hops.latest(pane)
    gains = seen.select(*keys, F.col("_v").isNotNull().cast("long").alias("_one"), first.alias("_from"), last.alias("_to")).where(F.col("_from") <= F.col("_to"))
    note = lambda j, sign: F.struct(j.alias("j"), F.lit(sign).cast("long").alias("any"), (F.col("_one") * sign).alias("some"))
    notes = gains.select(*keys, F.explode(F.array(note(F.col("_from"), 1), note(F.col("_to") + 1, -1))).alias("_n")).select(*keys, "_n.*")
    sums = notes.groupBy(*keys, "j").agg(F.sum("any").alias("any"), F.sum("some").alias("some"))
    by_window = Window.partitionBy(*keys).orderBy("j")
    so_far = by_window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = sums.select(*keys, "j", F.lead("j").over(by_window).alias("_next"), F.sum("any").over(so_far).alias("_any"), F.sum("some").over(so_far).alias(name))
    windows = runs.where(F.col("_any") > 0).withColumn("_j", F.explode(F.sequence(F.col("j"), F.col("_next") - 1)))
    return windows.select(*keys, name, *hops.bounds(F.col("_j"), df.schema[ts].dataType))


def session_agg(df: DataFrame, ts: str, gap: str, keys: Sequence[str | Column], *aggs: Column) -> DataFrame:
    """``GROUP BY SESSION(ts, gap), keys`` with the built-in session window (batch and stream)."""
    return (
        df.groupBy(F.session_window(ts, gap).alias("_w"), *keys)
        .agg(*aggs)
        .withColumn("window_start", F.col("_w.start"))
        .withColumn("window_end", F.col("_w.end"))
        .drop("_w")
    )


def _session_panes(df: DataFrame, ts: str, gap: str, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Panes as wide as the gap (``_pane``), with the number of their session in the key (``_session``)."""
    panes = df.where(F.col(ts).isNotNull()).groupBy(_pane(ts, micros_of(gap)).alias("_pane"), *keys).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), *aggs)
    by_time = Window.partitionBy(*keys).orderBy("_first")
    opens = F.col("_first") > F.lag("_last").over(by_time) + _interval(gap)
    return panes.withColumn("_opens", F.coalesce(opens, F.lit(True)).cast("int")).withColumn("_session", F.sum("_opens").over(by_time))


def session_panes(df: DataFrame, ts: str, gap: str, keys: Sequence[str], aggs: Aggs) -> DataFrame:
    """Session windows built from panes as wide as the gap (batch, mergeable aggregates).

    Two rows of one pane are always less than a gap apart, so a pane belongs to
    one session. After the map-side combine a key contributes at most one row
    per pane, so a key holding a third of all rows costs its time range divided
    by the gap, not its row count. Rows exactly one gap apart share a session.
    """
    panes = _session_panes(df, ts, gap, keys, *[partial.alias(name) for name, (partial, _) in aggs.items()])
    return (
        panes.groupBy(*keys, "_session")
        .agg(
            F.min("_first").alias("window_start"),
            (F.max("_last") + _interval(gap)).alias("window_end"),
            *[merge(F.col(name)).alias(name) for name, (_, merge) in aggs.items()],
        )
        .drop("_session")
    )


def session(df: DataFrame, ts: str, gap: str, keys: Sequence[str]) -> DataFrame:
    """Every row with the bounds of its session, for any aggregate (batch).

    Sessions are found on panes (see ``session_panes``); a row meets its session
    by key and pane, so no task sorts the rows of a key. Rows without a time
    belong to no session and are left out.
    """
    whole = Window.partitionBy(*keys, "_session")
    found = _session_panes(df, ts, gap, keys).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_pane").alias("_k__pane"),
        F.min("_first").over(whole).alias("window_start"),
        (F.max("_last").over(whole) + _interval(gap)).alias("window_end"),
    )
    rows = df.withColumn("_pane", _pane(ts, micros_of(gap)))
    same = F.col("_pane") == F.col("_k__pane")
    for k in keys:
        same = same & rows[k].eqNullSafe(found[f"_k_{k}"])
    return rows.join(found, same).drop("_pane", "_k__pane", *[f"_k_{k}" for k in keys])


def cumulate_panes(df: DataFrame, ts: str, step: str, size: str, keys: Sequence[str], aggs: Aggs) -> DataFrame:
    """Cumulating windows from panes of one step.

    Panes are aggregated first, then accumulated inside their outer window, which
    holds ``size/step`` panes at most. A step without new rows repeats the last
    result, so a window is reported at every step from the first one with data.
    """
    _check_steps(step, size)
    panes = (
        df.withColumn("_p", F.window(ts, step))
        .withColumn("_o", F.window(ts, size))
        .groupBy("_o", "_p", *keys)
        .agg(*[partial.alias(name) for name, (partial, _) in aggs.items()])
        .withColumn("window_start", F.col("_o.start"))
        .withColumn("_limit", F.col("_o.end"))
        .withColumn("_end", F.col("_p.end"))
        .drop("_o", "_p")
    )
    by_pane = Window.partitionBy(*keys, "window_start").orderBy("_end")
    so_far = by_pane.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.coalesce(F.lead("_end").over(by_pane) - _interval(step), F.col("_limit"))
    return (
        panes.withColumn("_upto", upto)
        .select(
            *keys,
            "window_start",
            F.sequence("_end", "_upto", _interval(step)).alias("_ends"),
            *[merge(F.col(name)).over(so_far).alias(name) for name, (_, merge) in aggs.items()],
        )
        .withColumn("window_end", F.explode("_ends"))
        .drop("_ends")
    )
