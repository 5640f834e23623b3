"""Connected components of a graph given as a table of links.

Alternating stars: every node points its larger neighbours to the smallest node
it knows (large star), then its smaller ones (small star), until nothing moves.
Each round is aggregates with a map-side minimum and joins, which Spark can split
where one node has very many neighbours; no node's neighbours are gathered. Every
round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import settled


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u") % 1_000_003)).first())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``, 64-bit); the component is its smallest node.

    Links may repeat and point either way; a link from a node to itself adds nothing.
    """
    links = links.where(F.col("a") != F.col("b"))
    now = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        rest = up.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settled(rest.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        last, mark = mark, _mark(now)
        if mark == last:
            break
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
