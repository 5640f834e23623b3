"""Mixing sources to target weights by Sainte-Laguë apportionment.

Everything is words. A source's target is its weight's share of all words,
stopped at ``MAX_REPEAT`` times what it has. Blocks of equal size are seats:
first all seats go to sources by highest quotients ``target / (2k + 1)``, then a
source's seats go to its shards in the same way, weighted by shard size. A shard
lies in a seeded order on a line of words cut into its blocks; seats beyond a
whole number of rounds go to a run of blocks that starts at a seeded place (the
line is a ring). A document is taken as often as blocks that cover it are.

A shard holds about ``SHARD_ROWS`` documents, so a source with a third of the
rows is many shards, and nothing wider than a shard is ordered. Tables of one
row per source, and of one per shard, are all else that is gathered.

Cases: a null or empty text has size 0 and is never taken; a null source is a
source of its own, last in order; rows without an id, or of one id, are parted by
their texts, and those with equal texts are interchangeable; an empty table gives an empty result; further columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import settled

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
MAX_REPEAT = 3
SHARD_ROWS = 4096
BLOCKS = 1 << 20  # at least so many blocks, and at least BLOCKS_PER_SHARD a shard
BLOCKS_PER_SHARD = 256
SEED = 7


def word_count(text: Column) -> Column:
    r"""Runs of ``[^\x20\x09-\x0D]`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _draw(*parts: Column) -> Column:
    """A number below 2**32 that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_REPEAT) -> DataFrame:
    """Adds ``rank``, ``weight``, ``total`` and ``target`` to one row per source (``source, source_size``).

    With the sources in order of ``most * size / weight``, those that stop at
    their limit come first: one is among them if the words still to give out,
    shared by weight among it and all after it, reach its limit. That is where
    resharing the excess until none is above its limit ends.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    everything = Window.partitionBy()
    full_first = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = full_first.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    left = F.col("total") - F.coalesce(F.sum("limit").over(before), none)
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), none)
    full = F.col("limit") * F.col("left_weight") <= F.col("left") * F.col("weight")
    free = F.col("total") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(none)).over(everything)
    free_weight = F.sum(F.when(F.col("full"), none).otherwise(F.col("weight"))).over(everything)
    return (
        sources.withColumn("rank", F.row_number().over(in_order))
        .withColumn("weight", weight)
        .withColumn("limit", (F.col("source_size") * most).cast("double"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumns({"left": left, "left_weight": left_weight})
        .withColumn("full", full)
        .withColumns({"free": free, "free_weight": free_weight})
        .withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * F.col("free") / F.col("free_weight")))
        .drop("limit", "left", "left_weight", "full", "free", "free_weight")
    )


def sainte_lague(df: DataFrame, group: Sequence[str], votes: str, n_seats: str, tie: str, out: str) -> DataFrame:
    """Adds ``out``: the seats of each row when ``n_seats`` of its group go to the highest ``votes / (2k + 1)``.

    Seats that a row has for certain are counted by a formula (with ``n`` rows,
    the divisor lies within ``n/2`` seats of the plain quota), so only about
    three quotients a row are ranked. Ties go to the lower ``tie``.
    """
    whole = Window.partitionBy(*group)
    n = F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(whole)
    quota = F.col(votes) / F.sum(votes).over(whole)
    bounds = df.withColumns({"_n": n, "_q": F.when(F.col(votes) > 0, quota).otherwise(F.lit(0.0))}).withColumns(
        {
            "_sure": F.greatest(F.lit(0), F.floor(F.col("_q") * (F.col(n_seats) - F.col("_n") / 2) + 0.5) - 1).cast("long"),
            "_most": F.when(F.col(votes) > 0, F.floor(F.col("_q") * (F.col(n_seats) + F.col("_n") / 2) + 0.5) + 1).otherwise(0).cast("long"),
        }
    )
    bounds = bounds.withColumn("_open", F.col(n_seats) - F.sum("_sure").over(whole))
    # One past the last seat is a blank, so that rows without an open seat stay.
    seats = bounds.withColumn("_k", F.explode(F.sequence("_sure", F.greatest("_most", F.col("_sure")))))
    real = F.col("_k") < F.col("_most")
    seats = seats.withColumn("_share", F.when(real, F.col(votes) / (2 * F.col("_k") + 1)))
    best = Window.partitionBy(*group).orderBy(F.col("_share").desc_nulls_last(), tie, "_k")
    won = (F.row_number().over(best) <= F.col("_open")) & real
    keys = df.columns
    return (
        seats.withColumn("_won", won.cast("long"))
        .groupBy(*keys)
        .agg((F.first("_sure") + F.sum("_won")).alias(out))
    )


def quotas(sized: DataFrame, weights: Sequence[int] = WEIGHTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """One row per source with its target and shards, and one per (source, shard) with its seats and run of blocks.

    ``sized`` has ``doc_id, source, size, _salt`` and is read twice.
    """
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")), weights)
    everything = Window.partitionBy()
    block = F.floor(F.col("total") / F.greatest(F.lit(BLOCKS), F.sum("_shards").over(everything) * BLOCKS_PER_SHARD))
    by_source = (
        by_source.withColumn("_shards", F.ceil(F.col("_rows") / SHARD_ROWS))
        .withColumn("_block", F.greatest(F.lit(1), block).cast("long"))
        .withColumn("_blocks", F.round(F.col("total") / F.col("_block")).cast("long"))
    )
    by_source = settled(sainte_lague(by_source, [], "target", "_blocks", "rank", "source_blocks"))
    cells = placed(sized, by_source, seed).groupBy("rank", "shard", "_block", "source_blocks").agg(F.sum("size").alias("shard_size"))
    cells = sainte_lague(cells, ["rank"], "shard_size", "source_blocks", "shard", "seats")
    c, m = F.col("shard_size"), F.col("blocks")
    edge = lambda block: F.floor(block * c / m)
    cells = (
        cells.withColumn("blocks", F.greatest(F.lit(1), F.round(c / F.col("_block"))).cast("long"))
        .withColumn("seats", F.least("seats", MAX_REPEAT * m))
        .withColumn("rounds", F.floor(F.col("seats") / m))
        .withColumn("_first", _draw(F.lit(str(seed)), F.col("rank").cast("string"), F.col("shard").cast("string")) % m)
        .withColumn("_last", F.col("_first") + F.col("seats") % m)
        .withColumn("_from", edge(F.col("_first")))
        .withColumn("_to", edge(F.least("_last", m)))
        .withColumn("_wrap", edge(F.greatest(F.col("_last") - m, F.lit(0))))
    )
    return by_source, settled(cells.select("rank", "shard", "seats", "rounds", "_from", "_to", "_wrap"))


def salt(text: Column) -> Column:
    """What parts rows without an id, or of one id, in the seeded order."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("_salt")


def placed(rows: DataFrame, by_source: DataFrame, seed: int) -> DataFrame:
    """Adds a row's source figures, its shard and its key in the seeded order."""
    place = by_source.select(F.col("source").alias("_s"), "rank", "source_size", "target", "_shards", "_block", "source_blocks")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("_salt")))
    return (
        rows.join(place, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_key", key)
        .withColumn("shard", F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % F.col("_shards"))
    )


def taken(rows: DataFrame, by_source: DataFrame, cells: DataFrame, seed: int) -> DataFrame:
    """Adds ``taken`` to ``rows`` (``doc_id, source, size`` and anything else)."""
    line = Window.partitionBy("rank", "shard").orderBy("_key", "doc_id", "size")
    end = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    covered = lambda a, b: F.greatest(F.lit(0), F.least(F.col("_end"), b) - F.greatest(F.col("_end") - F.col("size"), a))
    words = F.col("rounds") * F.col("size") + covered(F.col("_from"), F.col("_to")) + covered(F.lit(0), F.col("_wrap"))
    out = placed(rows, by_source, seed).withColumn("_end", end).join(cells, ["rank", "shard"])
    return out.withColumn("taken", words.cast("long"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and the quota behind them, for every document."""
    sized = settled(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), salt(F.col("text"))))
    return taken(sized, *quotas(sized, weights, seed), seed).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        F.col("rank").cast("int").alias("source_rank"),
        F.col("shard").cast("long").alias("shard"),
        F.col("seats").alias("shard_quota"),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Documents as often as the mix takes them, whole and with all their columns.

    A document at the edge of a run of blocks, which the mix takes in part, is
    there once more with the probability of that part (a seeded draw), so that
    sums stay near the quota and no text is cut.
    """
    size = word_count(F.col("text"))
    sized = settled(docs.select("doc_id", "source", size.alias("size"), salt(F.col("text"))))
    rows = docs.select("doc_id", "source", size.alias("size"), salt(F.col("text")), F.struct(*docs.columns).alias("_row"))
    whole, part = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    draw = F.conv(F.substring("_key", 9, 8), 16, 10).cast("long")
    counted = taken(rows, *quotas(sized, weights, seed), seed).where(F.col("taken") > 0)
    counted = counted.withColumn("_copies", whole + (draw * F.col("size") < part * (1 << 32)).cast("long"))
    copies = counted.where(F.col("_copies") > 0).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return copies.select(*[F.col(f"_row.{c}").alias(c) for c in docs.columns])
