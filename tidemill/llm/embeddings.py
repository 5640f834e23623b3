"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosines, connected components.

Equal vectors are one class first, with a count, so copies are never paired. A
class gets one code per table: the signs of its products with ``bits`` random
hyperplanes. Classes that share a code in some table are compared exactly.
``bits`` grows with the logarithm of the number of classes, so that a bucket
keeps about ``BUCKET`` of them, and the number of tables grows so that a pair at
the threshold meets in some table with probability ``RECALL``.

A bucket above ``BLOCK`` classes is cut into blocks, and each pair of blocks is
compared on its own. No pairs are emitted: a comparison yields, per class, how
many vectors it is linked with and the smallest id of its local component. A pair
that met in an earlier table is not counted again.

Cases: a vector that is null, empty, zero, or holds a null or a non-finite
component links with nothing, nor do vectors of different lengths or rows
without an id (their component is null, and they are not kept); repeated rows
are other vectors to each other; rows that share an id are one node of the
graph; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import SMALL_BYTES, partitions, settled, sorted_runs, tidied
from tidemill.llm.components import components

THRESHOLD = 0.9
RECALL = 0.995  # of pairs exactly at the threshold; nearer pairs are found more surely
BUCKET = 1024  # few bits and few tables: a vector is shuffled once a table, and comparing is cheap beside that
BLOCK = 4096
TILE = 512  # rows of a block that are multiplied at a time
SEED = 11


def usable(vector: Column) -> Column:
    """Holds only finite components, and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def plan(classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits per code and number of tables for so many distinct vectors."""
    bits = max(1, math.ceil(math.log2(max(classes, 2) / BUCKET)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def codes_of(vectors: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """A code per vector and table. Vectors of one length get the same hyperplanes everywhere."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    signs = (vectors @ planes >= 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _pairs(x: np.ndarray, left: slice, right: slice, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two blocks whose cosine reaches the threshold, each block's counted from its start."""
    found = []
    for at in range(left.start, left.stop, TILE):
        linked = x[at : min(at + TILE, left.stop)] @ x[right].T >= threshold
        if same:
            k = np.arange(len(linked))
            linked[k, k + at - left.start] = False
        i, j = np.nonzero(linked)
        found.append((i + at - left.start, j))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _compare(left: slice, right: slice, same: bool, table: int, x, codes, copies, ids, threshold) -> pd.DataFrame | None:
    """Links between two blocks of one bucket: counts and local components per class."""
    i, j = _pairs(x, left, right, same, threshold) if left.stop > left.start and right.stop > right.start else ((), ())
    if not len(i):
        return None
    # Only pairs that meet here first are counted here.
    first = (codes[left][i, :table] != codes[right][j, :table]).all(1) if table else np.ones(len(i), bool)
    n_left, n_right = len(codes[left]), len(codes[right])
    count = np.zeros(n_left + (0 if same else n_right), np.int64)
    np.add.at(count, i[first], copies[right][j[first]])
    if not same:
        np.add.at(count, n_left + j[first], copies[left][i[first]])
    node = ids[left] if same else np.concatenate((ids[left], ids[right]))
    a, b = (i, j) if same else (i, n_left + j)
    root = node.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        if (new == root).all():
            break
        root = new
    touched = np.unique(np.concatenate((a, b)))
    return pd.DataFrame({"id": node[touched], "links": count[touched], "root": root[touched]})


def linked_classes(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``id, links, root`` rows for classes ``id, copies, vector``: one or more per class that has links."""
    bits, tables = plan(classes.count(), threshold)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = batch["vector"].map(len)
            for _, own in batch.groupby(length.to_numpy()):
                x = np.stack(own["vector"].to_numpy()).astype(np.float64)
                yield own.assign(codes=list(codes_of(x, bits, tables)))

    kind = classes.schema["vector"].dataType.simpleString()
    coded = settled(classes.mapInPandas(tidied(code), f"id long, copies long, vector {kind}, codes array<long>"))
    key = ["dim", "t", "code"]
    each = coded.select("*", F.size("vector").alias("dim"), F.posexplode("codes").alias("t", "code"))
    hot = each.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    hot = settled(hot.select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    # What travels is the vector; the codes of other tables are computed again where they are asked for.
    entries = each.select("id", "copies", "vector", *key)
    n_hot = hot.count()
    if n_hot:
        entries = entries.join(F.broadcast(hot) if 32 * n_hot <= SMALL_BYTES else hot, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    else:
        entries = entries.withColumn("blocks", F.lit(1))
    entries = entries.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = [*key, "low", "high"]
    entries = entries.select(
        "id", "copies", "vector", "dim", "t", "code", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in sorted_runs(batches, key):
            x = np.stack(frame["vector"].to_numpy()) if frame["dim"].nunique() == 1 else None
            copies, ids = frame["copies"].to_numpy(), frame["id"].to_numpy()
            own, low, high, t = (frame[c].to_numpy() for c in ("own", "low", "high", "t"))
            for a, z in bounds:
                if z - a < 2:
                    continue
                v = np.stack(frame["vector"].iloc[a:z].to_numpy()).astype(np.float64) if x is None else x[a:z].astype(np.float64)
                codes = codes_of(v, bits, tables)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                same = low[a] == high[a]
                cut = z - a if same else int((own[a:z] == low[a]).sum())
                left, right = slice(0, cut), slice(0, cut) if same else slice(cut, z - a)
                found = _compare(left, right, same, int(t[a]), v, codes, copies[a:z], ids[a:z], threshold)
                if found is not None:
                    yield found

    dealt = entries.repartition(partitions(classes.sparkSession), *key).sortWithinPartitions(*key, "own", "id")
    return dealt.mapInPandas(tidied(compare), "id long, links long, root long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    rows = embeddings.select("vec_id", F.col("embedding").alias("vector"))
    good = rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    classes = good.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = settled(classes.withColumn("class", F.monotonically_increasing_id()))  # two classes may have one smallest id
    found = settled(linked_classes(classes.select(F.col("class").alias("id"), "copies", "vector"), threshold))
    found = found.withColumnsRenamed({"id": "class"})
    first = classes.select("class", F.col("id").alias("a"))
    roots = classes.select(F.col("class").alias("root"), F.col("id").alias("b"))
    near = found.select("class", "root").distinct().join(first, "class").join(roots, "root").select("a", "b")
    again = good.groupBy("vec_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("vec_id")
    shared = good.join(again, "vec_id", "left_semi").join(classes.select("vector", "id"), "vector").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    groups = components(near.unionAll(shared))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    result = (
        classes.join(links, "class", "left")
        .join(groups.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "vector",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    linkable = rows.withColumn("vector", F.when(usable(F.col("vector")) & F.col("vec_id").isNotNull(), F.col("vector")))
    out = linkable.where(F.col("vector").isNotNull()).join(result, "vector")
    alone = linkable.where(F.col("vector").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.select("vec_id", "n_links", "component_id").unionAll(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
