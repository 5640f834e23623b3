"""Sharding by fixed virtual slots.

A record belongs to one of a fixed number of virtual slots, for good. Which
shard holds a slot is a small versioned map, a table in the shared folder. Sharding reads
the newest version; where the loads ask for it, the map is edited by moving whole
slots, stored as the next version, and read back. A record's slot never changes.
The law kept is ``bytes``: shard sizes come as near to each other as moving and
swapping slots can bring them.

Equal texts do not stay together: a text that a third of the rows share would fill
a shard beyond its even share, which the law forbids. The slot therefore hashes
the id with the text, so that copies are dealt like all other rows.

Cases: a null text has no bytes and counts 1; rows that are equal in every
respect share a slot; an empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import settled
from tidemill.session import shared_dir

SLOTS = 4096  # fixed for the life of a corpus
LAW = "bytes"


@dataclass(frozen=True)
class SlotMap:
    """Slot number to shard, with the version of this edition of the map."""

    version: int
    shard_of: tuple[int, ...]
    n_shards: int

    @classmethod
    def first(cls, n_shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(1, tuple(s % n_shards for s in range(slots)), n_shards)

    def rebalanced(self, load: Sequence[int], n_shards: int | None = None) -> SlotMap:
        """The next version: slots go from the heaviest shard to lighter ones while that evens the two out.

        ``n_shards`` may be larger than before; the new shards then start empty.
        Every step lowers the sum of squared shard loads, so the search ends.
        """
        n = n_shards or self.n_shards
        if n < self.n_shards:
            raise ValueError("a map can gain shards, not lose them")
        held: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (load, slot), sorted
        for slot, shard in enumerate(self.shard_of):
            if load[slot]:
                held[shard].append((load[slot], slot))
        for slots in held:
            slots.sort()
        total = [sum(x for x, _ in slots) for slots in held]
        shard_of = list(self.shard_of)

        def move(a: int, b: int, item: tuple[int, int]) -> None:
            held[a].remove(item)
            held[b].insert(bisect_left(held[b], item), item)
            total[a] -= item[0]
            total[b] += item[0]
            shard_of[item[1]] = b

        while True:
            top = max(range(n), key=lambda s: total[s])
            for low in sorted(range(n), key=lambda s: total[s]):
                best = _best_exchange(held[top], held[low], total[top] - total[low])
                if best:
                    give, take = best
                    move(top, low, give)
                    if take:
                        move(low, top, take)
                    break
            else:
                return SlotMap(self.version + 1, tuple(shard_of), n)

    def table(self, spark: SparkSession) -> DataFrame:
        """The stored form: one row per slot."""
        rows = [(self.version, slot, shard, self.n_shards) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, virtual_slot int, shard int, n_shards int")

    def publish(self, spark: SparkSession, folder: str) -> None:
        """Store this version beside the earlier ones; a version is never overwritten."""
        self.table(spark).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={self.version}")

    @classmethod
    def stored(cls, spark: SparkSession, folder: str) -> SlotMap | None:
        """The newest version in a folder, if it holds any."""
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return cls.read(spark.read.schema("virtual_slot int, shard int, n_shards int, version int").parquet(folder))

    @classmethod
    def read(cls, table: DataFrame) -> SlotMap:
        """The newest version in a table of maps (``SLOTS`` rows a version)."""
        newest = table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == newest).orderBy("virtual_slot").collect()
        return cls(newest, tuple(r.shard for r in rows), rows[0].n_shards)


def _best_exchange(heavy, light, gap):
    """The slot of ``heavy``, or the pair with one of ``light`` to swap it for, whose move shifts nearest to half the gap."""
    best, best_off = None, gap  # a shift of 0 or of the whole gap changes nothing
    for take in [None, *light]:
        back = take[0] if take else 0
        i = bisect_left(heavy, (back + gap / 2, -1))
        for give in heavy[max(0, i - 1) : i + 1]:
            off = abs(gap - 2 * (give[0] - back))
            if off < best_off:
                best, best_off = (give, take), off
        if best and take is None and best_off * 8 <= gap:
            return best  # one move does it
    return best


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` of every row. Size: UTF-8 bytes of the text plus 1."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    slot = F.pmod(F.xxhash64("doc_id", crc), F.lit(slots)).cast("int")
    return docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), slot.alias("virtual_slot"))


def slot_loads(slotted: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot, ``slots`` numbers each."""
    size, rows = [0] * slots, [0] * slots
    for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.virtual_slot], rows[r.virtual_slot] = r.b, r.n
    return size, rows


def store_for(spark: SparkSession, name: str) -> str:
    """The folder of the maps of one corpus, in the shared folder."""
    return f"{shared_dir(spark)}/tidemill-slot-maps/{hashlib.sha256(name.encode()).hexdigest()[:16]}"


def shard(docs: DataFrame, n_shards: int, store: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Put every row into a shard; returns the rows and the map they follow.

    With a ``store`` (a folder) the newest map there is the one that is edited,
    and an edited map is stored. A map that needs no edit stays as it is.

    ``slot`` is the row's place in its shard, from 0 without gaps: the rows of
    the shard's earlier virtual slots, then its rank in its own. Nothing wider
    than a virtual slot is ever ordered.
    """
    spark = docs.sparkSession
    slotted = settled(with_slots(docs))
    load, rows = slot_loads(slotted)
    current = SlotMap.stored(spark, store) if store else None
    slot_map = (current or SlotMap.first(n_shards)).rebalanced(load, n_shards)
    if current and slot_map.shard_of == current.shard_of and slot_map.n_shards == current.n_shards:
        slot_map = current
    elif store:
        slot_map.publish(spark, store)
        slot_map = SlotMap.stored(spark, store)
    before, places = [0] * n_shards, []
    for s, where in enumerate(slot_map.shard_of):
        places.append((s, where, before[where]))
        before[where] += rows[s]
    small = F.broadcast(spark.createDataFrame(places, "virtual_slot int, shard int, _before long"))  # SLOTS rows
    ordered = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    out = slotted.withColumn("_rank", F.row_number().over(ordered)).join(small, "virtual_slot")
    return (
        out.select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            "shard",
            (F.col("_before") + F.col("_rank") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            F.lit(slot_map.version).alias("map_version"),
        ),
        slot_map,
    )
