"""Joins Spark has no single operator for: interval, as-of, containment, geofence.

Plain equi-joins are left to Catalyst and adaptive execution: a side is
broadcast only when its estimated size is under the configured threshold, and a
hot key of a sort-merge join is split at run time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.ordered import DEFAULT_SKEW, Ordered, Skew
from tidemill.operators.sizes import settle
from tidemill.operators.windows import micros_of

KeyPairs = Mapping[str, str]  # left column -> right column


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _width(interval: str) -> Column:
    """An interval text in microseconds; months and years have no fixed length."""
    if "month" in interval.lower() or "year" in interval.lower():
        raise ValueError(f"give the interval in weeks, days or smaller units: {interval}")
    return F.expr(f"timestampdiff(microsecond, timestamp'1970-01-01', timestamp'1970-01-01' + interval {interval})")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: KeyPairs,
    left_ts: str,
    right_ts: str,
    lower: str,
    upper: str,
    how: str = "inner",
) -> DataFrame:
    """``l.key = r.key AND r.ts BETWEEN l.ts + lower AND l.ts + upper``, both ends inclusive.

    Time is cut into buckets as wide as the interval and the bucket joins the
    equi key, so a hot key is spread over its time range instead of pairing
    every left row with every right row of the key. A left row looks into the
    bucket of its lower end only; right rows are copied into the bucket before
    theirs, so each matching pair meets exactly once. ``how`` is ``inner``,
    ``left`` or ``full``. Column names of both sides must differ.
    """
    width = F.greatest(_width(upper) - _width(lower), F.lit(1))
    low = F.col(left_ts) + F.expr(f"interval {lower}")
    high = F.col(left_ts) + F.expr(f"interval {upper}")
    left_bucket = F.expr("_us div _width")

    def bucketed(df: DataFrame, at: Column) -> DataFrame:
        return df.withColumn("_us", _micros(at)).withColumn("_width", width).withColumn("_b", left_bucket)

    def on(a: DataFrame, b: DataFrame) -> Column:
        cond = (F.col("_lb") == F.col("_rb")) & F.col(right_ts).between(low, high)
        for lk, rk in keys.items():
            cond = cond & (a[lk] == b[rk])
        return cond

    def plain(df: DataFrame, name: str) -> DataFrame:
        return df.withColumnRenamed("_b", name).drop("_us", "_width")

    lefts = plain(bucketed(left, low), "_lb")
    rights = plain(bucketed(right, F.col(right_ts)), "_b")
    rights = rights.withColumn("_rb", F.explode(F.array(F.col("_b") - 1, F.col("_b")))).drop("_b")
    if how == "inner":
        return lefts.join(rights, on(lefts, rights), "inner").drop("_lb", "_rb")
    matched = lefts.join(rights, on(lefts, rights), "left").drop("_lb", "_rb")
    if how == "left":
        return matched
    if how != "full":
        raise ValueError(f"how must be inner, left or full, not {how}")
    # Right rows without a partner: the same condition seen from the right, with
    # the left rows copied into both buckets they reach.
    wide = plain(bucketed(left, low), "_b")
    wide = wide.withColumn("_lb", F.explode(F.array(F.col("_b"), F.col("_b") + 1))).drop("_b")
    once = plain(bucketed(right, F.col(right_ts)), "_rb")
    alone = once.join(wide, on(wide, once), "left_anti").drop("_rb")
    return matched.unionByName(alone, allowMissingColumns=True)


def as_of_join(
    left: DataFrame,
    versions: DataFrame,
    keys: KeyPairs,
    left_ts: str,
    version_ts: str,
    columns: Sequence[str],
    sequence: Sequence[str] = (),
    deleted: Column | None = None,
    how: str = "left",
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """The latest version of the key at or before each left row's time.

    Both sides are placed on one time line per key and the last version seen is
    carried forward, so each side is shuffled once and no pairs are built, even
    for a key with many rows on both sides (see ``Ordered`` for hot keys). Among
    versions of one instant the last by ``sequence`` wins. A version for which
    ``deleted`` holds means "no match". ``columns`` of the version are added.
    """
    names = list(keys)
    tie = [f"_t{i}" for i in range(len(sequence))]
    kinds = [versions.schema[c].dataType for c in sequence]
    payload = T.StructType([T.StructField("_gone", T.BooleanType())] + [versions.schema[c] for c in columns])
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    probes = left.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(names)],
        F.col(left_ts).alias("_at"),
        F.lit(1).alias("_side"),
        *[F.lit(None).cast(k).alias(t) for k, t in zip(kinds, tie)],
        F.struct(*left.columns).alias("_row"),
        F.lit(None).cast(payload).alias("_v"),
    )
    facts = versions.select(
        *[F.col(keys[k]).alias(f"_k{i}") for i, k in enumerate(names)],
        F.col(version_ts).alias("_at"),
        F.lit(0).alias("_side"),
        *[F.col(c).alias(t) for c, t in zip(sequence, tie)],
        F.lit(None).cast(probes.schema["_row"].dataType).alias("_row"),
        F.struct(gone.alias("_gone"), *columns).cast(payload).alias("_v"),
    )
    line = Ordered(
        probes.unionByName(facts), [f"_k{i}" for i in range(len(names))], "_at", ["_side", *tie], skew=skew
    )
    known = line.running({"_seen": ("last", F.col("_v"))}).where(F.col("_side") == 1)
    # A null key or time matches nothing, as in an ordinary join.
    usable = F.col("_at").isNotNull()
    for i in range(len(names)):
        usable = usable & F.col(f"_k{i}").isNotNull()
    alive = usable & F.col("_seen").isNotNull() & ~F.col("_seen._gone")
    if how == "inner":
        known = known.where(alive)
    return known.select("_row.*", *[F.when(alive, F.col(f"_seen.{c}")).alias(c) for c in columns])


def validity_join(
    left: DataFrame,
    ranges: DataFrame,
    keys: KeyPairs,
    left_ts: str,
    start: str,
    end: str,
    how: str = "left",
    grain: str | None = None,
) -> DataFrame:
    """Rows whose time lies in ``[start, end]`` of a range with the same key; several may match.

    A range is laid on pieces of time about as long as itself or up to eight times
    shorter, two to nine of them; one longer than all the time ``left`` spans, as one
    that ends in 9999, counts with its length therein. A point lies in one piece of a
    length. Piece and key make an equi-join without doubled pairs, which spreads a hot key over its
    time, and the exact times decide last. Lengths go by powers of eight from
    ``grain``, an hour unless given, which is best below the usual range. Where all
    ranges have one length so measured, ``left`` is shuffled once, as it is; else the
    distinct points (key and time) are copied once per length that occurs, and
    ``left`` is joined with what they found. ``how`` may be any join.
    """
    names = list(keys)
    bits = micros_of(grain or "1 hour").bit_length() - 1  # pieces of a power of two, at most the grain
    us = lambda c: _micros(F.col(c))
    times = left.agg(F.min(us(left_ts)), F.max(us(left_ts))).first()
    first, last = F.greatest(us(start), F.lit(times[0])), F.least(us(end), F.lit(times[1]))
    if times[0] is None:
        first = last = F.lit(None).cast("long")

    def piece(at: Column, level: Column) -> Column:
        return F.call_function("shiftright", at, (level * 3 + bits).cast("int"))

    within = F.col(start).isNotNull() & F.col(end).isNotNull() & (first <= last)  # of nulls, greatest and least take the other
    whole = us(end) - us(start)
    open_ended = whole > F.lit(times[1]) - F.lit(times[0])  # measured within the times of ``left``
    length = F.call_function("shiftright", F.when(open_ended, last - first).otherwise(whole), F.lit(bits))
    reach = ranges.where(within).withColumn("_level", F.floor((F.length(F.bin(length)) - 1) / 3).cast("int"))
    covered = reach.withColumn("_piece", F.explode(F.sequence(piece(first, F.col("_level")), piece(last, F.col("_level")))))
    used = sorted(r["_level"] for r in reach.select("_level").distinct().collect())  # at most 22 numbers
    inside = F.col("_piece") == F.col("_up")
    if len(used) == 1 and how in ("inner", "left"):
        same = inside & F.col(left_ts).between(F.col(start), F.col(end))
        placed = left.withColumn("_up", piece(us(left_ts), F.lit(used[0])))
        for k, r in keys.items():
            same = same & (placed[k] == covered[r])
        return placed.join(covered, same, how).drop("_up", "_piece", "_level")
    point = {f"_p{i}": k for i, k in enumerate(names)}
    points = left.select(*[F.col(k).alias(p) for p, k in point.items()], F.col(left_ts).alias("_at")).distinct()
    points = points.where(F.col("_at").isNotNull()).withColumn("_of", F.explode(F.array(*[F.lit(x) for x in used]).cast("array<int>")))
    points = points.withColumn("_up", piece(us("_at"), F.col("_of")))
    same = inside & (F.col("_of") == F.col("_level"))
    for p, k in point.items():
        same = same & (points[p] == covered[keys[k]])
    hits = points.join(covered, same & F.col("_at").between(F.col(start), F.col(end))).drop("_up", "_of", "_level", "_piece")
    back = left[left_ts] == hits["_at"]
    for p, k in point.items():
        back = back & (left[k] == hits[p])
    return left.join(hits, back, how).drop("_at", *point)


def contains_join(texts: DataFrame, names: DataFrame, text: str, name: str, gram: int = 4) -> DataFrame:
    """``text LIKE '%' || name || '%'`` with the name taken literally, without comparing all pairs.

    An inverted index: every run of ``gram`` characters that some name holds
    (all of a shorter name) points to the texts that hold it. Each name is looked
    up by its rarest run, so a run that all names share decides nothing. What is
    exploded and shuffled is a text's checksum and its runs, never the text;
    texts are joined back to the candidates, and ``contains`` decides. Empty
    names, which every text contains, are not matched.
    """
    size = F.least(F.length("_name"), F.lit(gram))
    held = F.transform(F.sequence(F.lit(1), F.length("_name") - size + 1), lambda i: F.substr(F.col("_name"), i, size))
    usable = names.where(F.length(name) > 0)
    runs = usable.select(F.col(name).alias("_name")).distinct().select("_name", F.explode(F.array_distinct(held)).alias("_gram"))
    lengths = runs.agg(F.collect_set(F.length("_gram"))).scalar()  # at most ``gram`` numbers
    last = F.length(text) - F.col("_n") + 1
    offered = F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(F.col(text), i, F.col("_n")))
    index = (
        texts.select(F.xxhash64(text).alias("_id"), text, F.explode(lengths).alias("_n"))
        .where(F.length(text) >= F.col("_n"))
        .select("_id", F.explode(F.array_distinct(offered)).alias("_gram"))
        .join(runs.select("_gram").distinct(), "_gram", "left_semi")
        .distinct()
    )
    index = settle(index)  # counted, then looked up
    counts = index.groupBy("_gram").agg(F.count("*").alias("_texts"))
    rarest = runs.join(counts, "_gram", "left").groupBy("_name").agg(F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_r"))
    looked_up = rarest.where(F.col("_r.n") > 0).select("_name", F.col("_r.g").alias("_gram"))
    found = index.join(looked_up, "_gram").select("_id", "_name").distinct()
    candidates = texts.join(found, F.xxhash64(text) == F.col("_id")).where(F.contains(F.col(text), F.col("_name")))
    return candidates.join(usable, F.col("_name") == F.col(name)).drop("_id", "_name")


def cross_with_list(df: DataFrame, items: DataFrame, most: int = 10_000) -> DataFrame:
    """Every row with every row of a short list; a list of more than ``most`` rows is refused.

    The list is sent to the executors, after its size is checked.
    """
    if items.limit(most + 1).count() > most:
        raise ValueError(f"the list has more than {most} rows")
    return df.crossJoin(F.broadcast(items))


def reconcile(
    legacy: DataFrame, current: DataFrame, keys: Sequence[str], compare: Mapping[str, str]
) -> DataFrame:
    """Full outer comparison of two versions of a table by key.

    ``compare`` maps a column to the status reported when it differs
    (null-safe), in order of precedence. Adds ``status``; compared columns come
    back twice, as ``legacy_<column>`` and ``current_<column>``.
    """
    a = legacy.select(
        *[F.col(k).alias(f"_a_{k}") for k in keys], F.lit(1).alias("_in_a"), *[F.col(c).alias(f"legacy_{c}") for c in compare]
    )
    b = current.select(
        *[F.col(k).alias(f"_b_{k}") for k in keys], F.lit(1).alias("_in_b"), *[F.col(c).alias(f"current_{c}") for c in compare]
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"_a_{k}") == F.col(f"_b_{k}"))
    status = F.when(F.col("_in_b").isNull(), "only in legacy").when(F.col("_in_a").isNull(), "only in current")
    for c, label in compare.items():
        status = status.when(~F.col(f"legacy_{c}").eqNullSafe(F.col(f"current_{c}")), label)
    return a.join(b, cond, "full").select(
        *[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys],
        *[f"legacy_{c}" for c in compare],
        *[f"current_{c}" for c in compare],
        status.otherwise("same").alias("status"),
    )


def point_in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over a ring given as ``array<struct<x, y>>`` (open or closed).

    An edge counts when it crosses the horizontal line through the point, its
    lower end included and its upper end not, at a place right of the point.
    """
    n = F.size(ring)
    crosses = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: _edge_crosses(x, y, F.get(ring, i), F.get(ring, (i + 1) % n)),
    )
    return F.aggregate(crosses, F.lit(False), lambda inside, c: inside != c)


def _edge_crosses(x: Column, y: Column, a: Column, b: Column) -> Column:
    spans = (a["y"] > y) != (b["y"] > y)
    at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
    return F.when(spans, x < at).otherwise(False)


def geofence_join(
    points: DataFrame, fences: DataFrame, x: str, y: str, ring: str, cell: float, how: str = "inner"
) -> DataFrame:
    """Each point with every fence whose ring contains it.

    Fences are laid on a grid of ``cell``-sized squares by their bounding box;
    point and fence meet by grid square (an equi-join), and the exact test runs
    on those candidates only. A point lies in one square, so no pair is doubled.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how}")
    xs = F.transform(F.col(ring), lambda p: p["x"])
    ys = F.transform(F.col(ring), lambda p: p["y"])

    def square(v: Column) -> Column:
        return F.floor(v / cell).cast("long")

    laid = (
        fences.withColumn("_gx", F.explode(F.sequence(square(F.array_min(xs)), square(F.array_max(xs)))))
        .withColumn("_gy", F.explode(F.sequence(square(F.array_min(ys)), square(F.array_max(ys)))))
    )
    placed = points.withColumn("_px", square(F.col(x))).withColumn("_py", square(F.col(y)))
    inside = (
        (F.col("_px") == F.col("_gx"))
        & (F.col("_py") == F.col("_gy"))
        & point_in_polygon(F.col(x), F.col(y), F.col(ring))
    )
    return placed.join(laid, inside, how).drop("_gx", "_gy", "_px", "_py")


def flag_members(df: DataFrame, members: DataFrame, keys: KeyPairs, flag: str) -> DataFrame:
    """Adds a boolean: does the key occur in ``members``. Repeated members add no rows."""
    known = members.select(*[F.col(r).alias(f"_m_{l}") for l, r in keys.items()]).distinct().withColumn("_hit", F.lit(True))
    cond = F.lit(True)
    for l in keys:
        cond = cond & (F.col(l) == F.col(f"_m_{l}"))
    return (
        df.join(known, cond, "left")
        .withColumn(flag, F.col("_hit").isNotNull())
        .drop("_hit", *[f"_m_{l}" for l in keys])
    )
