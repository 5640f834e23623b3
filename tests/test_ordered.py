"""Sliced operators must equal the plain window, hot key or not."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.operators.ordered import Ordered, Skew

# Slices from the first twenty rows of a key on; and no slices at all.
CUT, WHOLE = Skew(0.01, 20, 4, 0), Skew(0.01, 20, 4, 1 << 63)


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    rng = random.Random(1)
    data = []
    for i in range(500):
        key = None if i % 50 == 0 else (1 if rng.random() < 0.5 else rng.randint(2, 6))
        data.append((i, key, float(rng.randint(0, 40)) if rng.random() < 0.9 else 7.0, None if rng.random() < 0.2 else rng.randint(0, 9)))
    path = str(tmp_path_factory.mktemp("ordered") / "rows")
    spark.createDataFrame(data, "id long, k int, o double, v int").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def same(a, b):
    return sorted(a.collect(), key=lambda r: r.id) == sorted(b.select(*a.columns).collect(), key=lambda r: r.id)


def windows(down):
    order = [F.desc("o"), F.desc("id")] if down else ["o", "id"]
    w = Window.partitionBy("k").orderBy(*order)
    return w, Window.partitionBy("k").orderBy(order[0]), w.rowsBetween(Window.unboundedPreceding, 0)


@pytest.mark.parametrize("skew", [CUT, WHOLE], ids=["cut", "whole"])
@pytest.mark.parametrize("down", [False, True], ids=["up", "down"])
def test_running(rows, skew, down):
    line = Ordered(rows, ["k"], "o", ["id"], descending=down, skew=skew)
    assert line.cut == (skew is CUT)
    v = F.col("v")
    got = line.running(
        {"s": ("sum", v), "c": ("count", v), "lo": ("min", v), "hi": ("max", v), "fi": ("first", v), "la": ("last", v)}
    )
    _, _, u = windows(down)
    want = rows.select(
        "*",
        F.sum("v").over(u).alias("s"),
        F.count("v").over(u).alias("c"),
        F.min("v").over(u).alias("lo"),
        F.max("v").over(u).alias("hi"),
        F.first("v", True).over(u).alias("fi"),
        F.last("v", True).over(u).alias("la"),
    )
    assert same(got, want)


@pytest.mark.parametrize("skew", [CUT, WHOLE], ids=["cut", "whole"])
@pytest.mark.parametrize("down", [False, True], ids=["up", "down"])
def test_ranks(rows, skew, down):
    got = Ordered(rows, ["k"], "o", ["id"], descending=down, skew=skew).ranks(tiles=7, nth={"third": ("v", 3)})
    w, p, _ = windows(down)
    want = rows.select(
        "*",
        F.row_number().over(w).alias("row_number"),
        F.rank().over(p).alias("rank"),
        F.dense_rank().over(p).alias("dense_rank"),
        F.percent_rank().over(p).alias("percent_rank"),
        F.cume_dist().over(p).alias("cume_dist"),
        F.ntile(7).over(w).alias("ntile"),
        F.nth_value("v", 3).over(w).alias("third"),
    )
    assert same(got, want)


@pytest.mark.parametrize("skew", [CUT, WHOLE], ids=["cut", "whole"])
@pytest.mark.parametrize("down", [False, True], ids=["up", "down"])
def test_neighbours(rows, skew, down):
    exprs = {
        "before": lambda w: F.lag("v").over(w),
        "third_before": lambda w: F.lag("v", 3).over(w),
        "second_after": lambda w: F.lead("v", 2).over(w),
        "moving": lambda w: F.sum("v").over(w.rowsBetween(-4, 1)),
    }
    got = Ordered(rows, ["k"], "o", ["id"], descending=down, skew=skew).over_rows(exprs, before=4, after=2)
    w, _, _ = windows(down)
    assert same(got, rows.select("*", *[fn(w).alias(n) for n, fn in exprs.items()]))


def test_global_order(rows):
    got = Ordered(rows, [], "o", ["id"], skew=CUT).running({"n": ("count", F.lit(1)), "s": ("sum", F.col("v"))})
    u = Window.orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert same(got, rows.select("*", F.count("*").over(u).alias("n"), F.sum("v").over(u).alias("s")))


def test_heavy_keys_and_slices_are_bounded(rows):
    line = Ordered(rows, ["k"], "o", ["id"], skew=Skew(0.05, 1, 4, 0))
    heavy = line._heavy.count()
    slices = line.df.where("_total is not null").select("k", "_slice").distinct().count()
    assert 0 < heavy <= 1 / 0.05
    assert slices <= 2 * 4 / 0.05 + heavy  # the last value of a key may open one more
    # No slice of the hot key holds the key.
    assert line.df.groupBy("k", "_slice").count().where("k = 1").agg(F.max("count")).first()[0] < 200


def _odd(kind):
    """An ordering column of 400 rows with ties, nulls and odd values."""
    value = {
        "double": lambda i: None if i % 9 == 0 else float("nan") if i % 11 == 0 else float(i * 7 % 50),
        "string": lambda i: None if i % 9 == 0 else "" if i % 11 == 0 else f"w{i * 7 % 50}",
        "decimal(20,2)": lambda i: None if i % 9 == 0 else Decimal(i * 7 % 50),
        "boolean": lambda i: None if i % 9 == 0 else i % 2 == 0,
    }[kind]
    return [(i, 1 if i % 4 else None, value(i)) for i in range(400)]


@pytest.mark.parametrize("down", [False, True], ids=["up", "down"])
@pytest.mark.parametrize("kind", ["double", "string", "decimal(20,2)", "boolean"])
def test_cuts_take_any_order(spark, kind, down):
    df = spark.createDataFrame(_odd(kind), f"id long, k int, o {kind}").repartition(3, "id")
    line = Ordered(df, ["k"], "o", ["id"], descending=down, skew=CUT)
    assert line.cut
    o = F.desc("o") if down else F.asc("o")
    peers = Window.partitionBy("k").orderBy(o)
    w = Window.partitionBy("k").orderBy(o, F.desc("id") if down else F.asc("id"))
    want = df.select("id", F.row_number().over(w).alias("row_number"), F.rank().over(peers).alias("rank"), F.dense_rank().over(peers).alias("dense_rank"))
    got = line.ranks().select("id", "row_number", "rank", "dense_rank")
    assert same(got, want)


@pytest.mark.parametrize("values", ["if(id = 0, -1e15, id)", "if(id = 0, double('NaN'), id)", "if(id % 10 = 0, id * 1000, 5 + id / 1e6)"], ids=["stray", "nan", "burst"])
def test_slices_are_even(spark, values):
    df = spark.range(0, 20_000, 1, 4).select("id", F.lit(1).alias("k"), F.expr(values).cast("double").alias("o"))
    line = Ordered(df, ["k"], "o", ["id"], skew=Skew(0.1, 100, 4, 0))
    sizes = [r["count"] for r in line.df.groupBy("_slice").count().collect()]
    assert sum(sizes) == 20_000
    assert max(sizes) <= 2 * 20_000 / len(sizes)


def test_nth_value_far_into_a_hot_key(spark):
    df = spark.range(4000).select("id", F.lit(1).alias("k"), (F.col("id") % 100).cast("double").alias("o"))
    got = Ordered(df, ["k"], "o", ["id"], skew=Skew(0.01, 100, 4, 0)).ranks(nth={"x": ("id", 1500)})
    w = Window.partitionBy("k").orderBy("o", "id")
    assert same(got.select("id", "x"), df.select("id", F.nth_value("id", 1500).over(w).alias("x")))


def test_settle_writes_only_what_is_large(spark, rows):
    from tidemill.operators.sizes import settle

    assert settle(rows, above=1 << 40) is rows
    written = settle(rows.select("id"), above=0)
    assert "ExistingRDD" in written._jdf.queryExecution().executedPlan().toString()
    assert written.count() == rows.count()
