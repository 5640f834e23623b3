"""Per-key ordered operators that survive a hot key.

``OVER (PARTITION BY key ORDER BY ts)`` sorts one key in one task. That is fine
for most keys and fatal for one that holds a third of the table. Here a key
above a set share of the rows is cut into slices of its ordering column; every
slice is one window partition, and a small carry row per slice brings in what
came before. Light keys keep a single slice. Ordinary data costs one shuffle, as
the plain window would, plus a count per key.

Slices are the ranges into which Spark's range partitioning deals the rows of
heavy keys: their bounds follow the rows, so that a stray value or a burst does
not fill one slice, and any sortable type will do, nulls and NaN included. The
dealt rows are written to the shared folder once, which fixes their slices.

Sizes that are broadcast are bounded by construction: a heavy key has more than
``share`` of all rows, so there are at most ``1/share`` of them, and at most
``2 * oversplit / share`` slices (and one more a key), whatever the size of the table.

All functions expect ``df`` to be cheap to read twice (a scan, a view on one, or
a reliably checkpointed result), because heavy keys are found by a first pass.
Rows with equal ordering values always share a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemill.operators.sizes import at_most
from tidemill.session import reliable_checkpoint


@dataclass(frozen=True)
class Skew:
    """When a key counts as heavy, and how finely it is cut.

    Below ``min_bytes`` (the optimizer's estimate for the whole frame) any key
    fits a task and the search for heavy keys is left out.
    """

    share: float = 1e-4
    min_rows: int = 1_000_000
    oversplit: int = 4
    min_bytes: int = 64 << 20


DEFAULT_SKEW = Skew()
_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, Window.currentRow)


class Ordered:
    """One frame with its partition keys and ordering, cut into slices where needed."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: str,
        ties: Sequence[str] = (),
        descending: bool = False,
        skew: Skew = DEFAULT_SKEW,
    ):
        self.columns = df.columns
        if not keys:  # a global ordering is one very heavy key
            df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
        self.keys, self.order, self.ties = list(keys), order, list(ties)
        self.descending, self.skew = descending, skew
        slices = 0
        if not at_most(df, skew.min_bytes):
            self._heavy = self._find_heavy(df)
            slices = self._heavy.agg(F.sum("_cuts")).first()[0] or 0
        self.cut = slices > 0
        self.df = self._slice(df, slices) if self.cut else df.withColumn("_total", F.lit(None).cast("long"))
        self.parts = [*self.keys, "_slice"] if self.cut else self.keys

    def _find_heavy(self, df: DataFrame) -> DataFrame:
        counts = df.groupBy(*self.keys).agg(F.count("*").alias("_total"))
        total = counts.select(F.sum("_total")).scalar()
        limit = F.greatest(F.lit(float(self.skew.min_rows)), total * F.lit(self.skew.share))
        heavy = counts.where(F.col("_total") > limit).select(
            *[F.col(k).alias(f"_k_{k}") for k in self.keys],
            "_total",
            (F.ceil(F.col("_total") / limit) * self.skew.oversplit).alias("_cuts"),
        )
        return reliable_checkpoint(heavy)  # at most 1/share rows, read by several plans

    def _same_key(self, df: DataFrame, other: DataFrame) -> Column:
        cond = F.lit(True)
        for k in self.keys:
            cond = cond & df[k].eqNullSafe(other[f"_k_{k}"])
        return cond

    def _slice(self, df: DataFrame, slices: int) -> DataFrame:
        heavy = F.broadcast(self._heavy)  # at most 1/share rows
        light = df.join(heavy, self._same_key(df, heavy), "left_anti")
        rows = df.join(heavy, self._same_key(df, heavy)).drop(*[f"_k_{k}" for k in self.keys], "_cuts")
        dealt = rows.repartitionByRange(slices, *self.keys, self.order)
        dealt = reliable_checkpoint(dealt.withColumn("_slice", F.spark_partition_id().cast("long")))
        light = light.withColumn("_total", F.lit(None).cast("long")).withColumn("_slice", F.lit(0).cast("long"))
        return dealt.unionByName(light)

    # -- windows -----------------------------------------------------------
    def _ordering(self, reverse: bool = False) -> list[Column]:
        down = self.descending != reverse
        return [F.col(c).desc() if down else F.col(c).asc() for c in [self.order, *self.ties]]

    def _slice_order(self, reverse: bool = False) -> Column:
        return F.col("_slice").desc() if self.descending != reverse else F.col("_slice").asc()

    def window(self) -> WindowSpec:
        """The window inside one slice."""
        return Window.partitionBy(*self.parts).orderBy(*self._ordering())

    def _heavy_rows(self) -> DataFrame:
        return self.df.where(F.col("_total").isNotNull())

    def _carry(self, aggs: Sequence[Column], over: Mapping[str, Callable[[WindowSpec], Column]]) -> DataFrame:
        """One row per heavy slice: ``aggs`` of the slice, folded over the slices before it."""
        per_slice = self._heavy_rows().groupBy(*self.keys, "_slice").agg(*aggs)
        before = Window.partitionBy(*self.keys).orderBy(self._slice_order()).rowsBetween(*_BEFORE)
        return per_slice.select(
            *[F.col(k).alias(f"_k_{k}") for k in self.keys],
            F.col("_slice").alias("_k__slice"),
            *[fn(before).alias(name) for name, fn in over.items()],
        )

    def _with_carry(
        self, df: DataFrame, aggs: Sequence[Column], over: Mapping[str, Callable[[WindowSpec], Column]]
    ) -> DataFrame:
        if not self.cut:
            return df.select("*", *[F.lit(None).alias(name) for name in over])
        carry = F.broadcast(self._carry(aggs, over))  # at most 2 * oversplit / share rows
        cond = self._same_key(df, carry) & (df["_slice"] == carry["_k__slice"])
        return df.join(carry, cond, "left").drop(*[f"_k_{k}" for k in self.keys], "_k__slice")

    def _done(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        return df.select(*self.columns, *names)

    # -- operators ---------------------------------------------------------
    def running(self, aggs: Mapping[str, tuple[str, Column]], current: bool = True) -> DataFrame:
        """Aggregates from the first row of the key up to the current one (or up to the one before).

        ``aggs`` is ``{name: (kind, column)}`` with kind ``sum``, ``count``,
        ``min``, ``max``, ``first`` or ``last`` (both skip nulls).
        """
        upto = self.window().rowsBetween(*(_UPTO if current else _BEFORE))
        down = self.descending
        here, summary, fold = {}, [], {}
        stamp = F.struct(self.order, *self.ties)
        for name, (kind, column) in aggs.items():
            part, carried = f"_p_{name}", f"_c_{name}"
            seen = F.when(column.isNotNull(), stamp)
            if kind in ("sum", "min", "max"):
                fn = getattr(F, kind)
                here[name] = fn(column).over(upto)
                summary.append(fn(column).alias(part))
                fold[carried] = lambda w, fn=fn, part=part: fn(part).over(w)
            elif kind == "count":
                here[name] = F.count(column).over(upto)
                summary.append(F.count(column).alias(part))
                fold[carried] = lambda w, part=part: F.sum(part).over(w)
            elif kind in ("first", "last"):
                pick = F.min_by if (kind == "first") != down else F.max_by
                fn = F.first if kind == "first" else F.last
                here[name] = fn(column, ignorenulls=True).over(upto)
                summary.append(pick(column, seen).alias(part))
                fold[carried] = lambda w, fn=fn, part=part: fn(part, ignorenulls=True).over(w)
            else:
                raise ValueError(f"unknown running aggregate {kind}")
        local = self.df.select("*", *[c.alias(f"_l_{n}") for n, c in here.items()])
        out = self._with_carry(local, summary, fold)
        for name, (kind, _) in aggs.items():
            mine, prior = F.col(f"_l_{name}"), F.col(f"_c_{name}")
            out = out.withColumn(
                name,
                {
                    "sum": F.coalesce(prior + mine, prior, mine) if kind == "sum" else None,
                    "count": mine + F.coalesce(prior, F.lit(0)) if kind == "count" else None,
                    "min": F.least(prior, mine) if kind == "min" else None,
                    "max": F.greatest(prior, mine) if kind == "max" else None,
                    "first": F.coalesce(prior, mine),
                    "last": F.coalesce(mine, prior),
                }[kind],
            )
        return self._done(out, list(aggs))

    def ranks(self, tiles: int = 4, nth: Mapping[str, tuple[str, int]] | None = None) -> DataFrame:
        """All ranking columns at once, from one sort.

        Adds ``row_number``, ``rank``, ``dense_rank``, ``ntile``,
        ``percent_rank`` and ``cume_dist``; unused ones are pruned by the
        optimizer. ``rank`` and the columns after it rank by ``order`` alone.
        ``nth`` is ``{name: (column, n)}`` for NTH_VALUE with the default frame.
        """
        nth = nth or {}
        w = self.window()
        peers = Window.partitionBy(*self.parts).orderBy(self._ordering()[0])
        whole = Window.partitionBy(*self.parts)
        local = self.df.select(
            "*",
            F.row_number().over(w).cast("long").alias("_rn"),
            F.rank().over(peers).cast("long").alias("_rk"),
            F.dense_rank().over(peers).cast("long").alias("_dr"),
            F.count("*").over(peers).alias("_le"),
            F.count("*").over(whole).alias("_in_slice"),
        )
        out = self._with_carry(
            local,
            [F.count("*").alias("_p_n"), F.count_distinct(F.struct(self.order)).alias("_p_d")],
            {"_c_n": lambda b: F.sum("_p_n").over(b), "_c_d": lambda b: F.sum("_p_d").over(b)},
        )
        prior, prior_distinct = F.coalesce("_c_n", F.lit(0)), F.coalesce("_c_d", F.lit(0))
        out = (
            out.withColumn("row_number", F.col("_rn") + prior)
            .withColumn("rank", F.col("_rk") + prior)
            .withColumn("dense_rank", F.col("_dr") + prior_distinct)
            .withColumn("_n", F.coalesce("_total", "_in_slice"))
            .withColumn("percent_rank", F.when(F.col("_n") > 1, (F.col("rank") - 1) / (F.col("_n") - 1)).otherwise(0.0))
            .withColumn("cume_dist", (F.col("_le") + prior) / F.col("_n"))
            .withColumn("_q", F.expr(f"_n div {tiles}"))
            .withColumn("_big", F.expr(f"(_n % {tiles}) * (_q + 1)"))
            .withColumn(
                "ntile",
                F.expr(
                    f"if(row_number <= _big, (row_number - 1) div (_q + 1), "
                    f"_n % {tiles} + (row_number - 1 - _big) div greatest(_q, 1)) + 1"
                ),
            )
        )
        names = ["row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile"]
        if nth:
            # The n-th row of a heavy key is found once, for all its slices.
            first_n = Window.partitionBy(*self.keys).orderBy(*self._ordering())
            upto = w.rowsBetween(*_UPTO)
            for name, (column, n) in nth.items():
                here = F.max(F.when(F.col("_rn") == n, F.struct(F.col(column).alias("v")))).over(upto)
                out = out.withColumn("_here", here)
                names.append(name)
                if not self.cut:
                    out = out.withColumn(name, F.col("_here.v")).drop("_here")
                    continue
                if n <= 1000:  # pruned to n rows per key in every task, before any shuffle
                    at = self._heavy_rows().withColumn("row_number", F.row_number().over(first_n)).where(F.col("row_number") <= n)
                else:
                    at = out.where(F.col("_total").isNotNull())
                found = at.where(F.col("row_number") == n).select(
                    *[F.col(k).alias(f"_k_{k}") for k in self.keys], F.struct(F.col(column).alias("v")).alias("_nth")
                )
                heavy_nth = F.broadcast(found)  # one row per heavy key
                out = out.join(heavy_nth, self._same_key(out, heavy_nth), "left").drop(*[f"_k_{k}" for k in self.keys])
                value = F.when(F.col("_total").isNotNull(), F.when(F.col("row_number") >= n, F.col("_nth.v")))
                out = out.withColumn(name, value.otherwise(F.col("_here.v"))).drop("_here", "_nth")
        return self._done(out, names)

    def over_rows(
        self, exprs: Mapping[str, Callable[[WindowSpec], Column]], before: int = 0, after: int = 0
    ) -> DataFrame:
        """Window expressions that look at most ``before`` rows back and ``after`` ahead.

        LAG, LEAD and moving frames. Each heavy slice is given copies of the
        neighbouring rows it can see; light keys need none.
        """
        base = self.df.withColumn("_halo", F.lit(False))
        parts = [base]
        if before and self.cut:
            parts.append(self._halo(before, back=True))
        if after and self.cut:
            parts.append(self._halo(after, back=False))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        w = self.window()
        out = rows.select("*", *[fn(w).alias(name) for name, fn in exprs.items()])
        return self._done(out.where(~F.col("_halo")), list(exprs))

    def _halo(self, n: int, back: bool) -> DataFrame:
        """The ``n`` rows next to each heavy slice, labelled with that slice."""
        edge = Window.partitionBy(*self.keys, "_slice").orderBy(*self._ordering(reverse=back))
        rows = self._heavy_rows()
        payload = [c for c in rows.columns if c not in (*self.keys, "_slice")]
        near_first = F.array_sort(
            F.collect_list(F.struct("_at", F.struct(*payload).alias("_row"))), lambda a, b: a["_at"] - b["_at"]
        )
        edges = (
            rows.withColumn("_at", F.row_number().over(edge))
            .where(F.col("_at") <= n)
            .groupBy(*self.keys, "_slice")
            .agg(near_first.alias("_edge"))
        )
        away = Window.partitionBy(*self.keys).orderBy(self._slice_order(reverse=back)).rowsBetween(1, n)
        return (
            edges.withColumn("_near", F.slice(F.flatten(F.collect_list("_edge").over(away)), 1, n))
            .select(*self.keys, "_slice", F.explode("_near").alias("_e"))
            .select(*self.keys, "_slice", "_e._row.*", F.lit(True).alias("_halo"))
        )
