"""Long frames over a hot key: ``RANGE BETWEEN … PRECEDING`` and ``ROWS BETWEEN n PRECEDING``.

The ordering is cut into buckets, ``pieces`` to the length of a frame. The frame of
a row at ``x`` is then three parts that need no common task:

- its own bucket up to the row: a running aggregate inside the bucket;
- the whole buckets between: one row a bucket, merged in a frame over bucket numbers;
- the end of the bucket that the frame begins in: the row sends a probe there,
  and a running aggregate from the bucket's end answers it.

A key's rows are dealt by bucket, so a task holds a bucket of a key, not a key. No
part is a difference of running sums, so floating-point values lose nothing, and
minima and maxima work as sums do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.ordered import DEFAULT_SKEW, Ordered, Skew
from tidemill.operators.sizes import settle
from tidemill.operators.windows import floor_div, micros_of

_PARTIAL = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
PIECES = 16

Frame = Mapping[str, tuple[str, Column]]  # {name: (kind, column)}


def _merged(kind: str, parts: Sequence[Column]) -> Column:
    if kind in ("min", "max"):
        return {"min": F.least, "max": F.greatest}[kind](*parts)
    known = [F.coalesce(p, F.lit(0)) for p in parts]
    total = known[0] + known[1] + known[2]
    return total if kind == "count" else F.when(F.coalesce(*parts).isNotNull(), total)


def _over(df: DataFrame, keys: Sequence[str], x: Column, preceding: int, aggs: Frame, pieces: int) -> DataFrame:
    """``df`` with ``aggs`` over the rows of the key from ``x - preceding`` to ``x``, peers included; ``x`` is a whole number."""
    unknown = {k for k, _ in aggs.values()} - set(_PARTIAL)
    if unknown or preceding < 0:
        raise ValueError(f"unknown aggregates {sorted(unknown)}" if unknown else "the frame must reach back")
    source, names = df.columns, list(aggs)
    width = max(-(-preceding // pieces), 1)
    rows = df.withColumn("_x", x)
    for i, (_, column) in enumerate(aggs.values()):
        rows = rows.withColumn(f"_v{i}", column)
    kinds = [k for k, _ in aggs.values()]
    bucket = floor_div(F.col("_x"), width)
    begin = F.col("_x") - preceding
    rows = rows.withColumn("_b", bucket)
    own = Window.partitionBy(*keys, "_b").orderBy("_x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # A frame inside one bucket is an ordinary one; frames are at least a bucket long otherwise.
    here = rows.select("*", *[_PARTIAL[k](f"_v{i}").over(own).alias(f"_own{i}") for i, k in enumerate(kinds)])
    buckets = rows.groupBy(*keys, "_b").agg(*[_PARTIAL[k](f"_v{i}").alias(f"_all{i}") for i, k in enumerate(kinds)])
    # Whole buckets between: from the one behind the frame's first to the one before the row's. The first is _b - n or one later.
    n = preceding // width
    spans = {}
    for last, back in (("near", n - 1), ("far", n)):
        between = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-back, -1) if back >= 1 else None
        for i, k in enumerate(kinds):
            spans[f"_{last}{i}"] = _MERGE[k](f"_all{i}").over(between) if between is not None else F.lit(None).cast(buckets.schema[f"_all{i}"].dataType)
    whole = buckets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_k__b"), *[c.alias(name) for name, c in spans.items()])
    same = here["_b"].eqNullSafe(whole["_k__b"])
    for k in keys:
        same = same & here[k].eqNullSafe(whole[f"_k_{k}"])
    far = floor_div(begin, width) < F.col("_b") - n
    middle = [F.when(far, F.col(f"_far{i}")).otherwise(F.col(f"_near{i}")).alias(f"_mid{i}") for i in range(len(kinds))]
    joined = here.join(whole, same, "left").select(*source, "_x", "_b", *[f"_own{i}" for i in range(len(kinds))], *middle)
    # Probes and rows of the bucket the frame begins in, from its end; a probe sees the rows at its own place.
    parts = [f"_own{i}" for i in range(len(kinds))] + [f"_mid{i}" for i in range(len(kinds))]
    probes = joined.select(
        *keys,
        floor_div(begin, width).alias("_in"),
        begin.alias("_at"),
        F.struct(F.col("_b").alias("_b"), *parts, F.struct(*source).alias("_row")).alias("_probe"),
        *[F.lit(None).cast(rows.schema[f"_v{i}"].dataType).alias(f"_v{i}") for i in range(len(kinds))],
    )
    facts = rows.select(
        *keys, F.col("_b").alias("_in"), F.col("_x").alias("_at"), F.lit(None).cast(probes.schema["_probe"].dataType).alias("_probe"), *[f"_v{i}" for i in range(len(kinds))]
    )
    tail = Window.partitionBy(*keys, "_in").orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = probes.unionByName(facts).select("_in", "_probe", *[_PARTIAL[k](f"_v{i}").over(tail).alias(f"_end{i}") for i, k in enumerate(kinds)])
    seen = seen.where(F.col("_probe").isNotNull())
    inside = F.col("_in") == F.col("_probe._b")  # the frame begins in the row's own bucket: only for an empty reach
    ends = [F.when(~inside, F.col(f"_end{i}")) for i in range(len(kinds))]
    total = [_merged(k, [F.col(f"_probe._own{i}"), F.col(f"_probe._mid{i}"), ends[i]]) for i, k in enumerate(kinds)]
    return seen.select("_probe._row.*", *[c.alias(name) for c, name in zip(total, names, strict=True)])


def range_frame(df: DataFrame, keys: Sequence[str], ts: str, preceding: str, aggs: Frame, pieces: int = PIECES) -> DataFrame:
    """``OVER (PARTITION BY keys ORDER BY ts RANGE BETWEEN preceding PRECEDING AND CURRENT ROW)``.

    ``aggs`` is ``{name: (kind, column)}`` with kind ``sum``, ``count``, ``min``
    or ``max``. Rows without a time see each other, as in SQL.
    """
    timed = _over(df.where(F.col(ts).isNotNull()), keys, F.unix_micros(F.col(ts).cast("timestamp")), micros_of(preceding), aggs, pieces)
    alone = Window.partitionBy(*keys)
    untimed = df.where(F.col(ts).isNull()).select("*", *[_PARTIAL[k](c).over(alone).alias(name) for name, (k, c) in aggs.items()])
    return timed.unionByName(untimed)


def row_frame(
    df: DataFrame, keys: Sequence[str], order: str, preceding: int, aggs: Frame, ties: Sequence[str] = (), pieces: int = PIECES, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """``OVER (PARTITION BY keys ORDER BY order, ties ROWS BETWEEN preceding PRECEDING AND CURRENT ROW)`` for long frames."""
    numbered = Ordered(df, keys, order, ties, skew=skew).ranks().select(*df.columns, F.col("row_number").alias("_n"))
    numbered = settle(numbered, skew.min_bytes)  # read for the buckets, the rows and the probes
    return _over(numbered, keys, F.col("_n"), preceding, aggs, pieces).drop("_n")
