import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.operators import joins as J
from tidemill.operators.ordered import Skew

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def lefts(spark, rows):
    return spark.createDataFrame([(i, k, at(s)) for i, k, s in rows], "l long, lk int, lts timestamp_ntz")


def rights(spark, rows):
    return spark.createDataFrame([(i, k, at(s)) for i, k, s in rows], "r long, rk int, rts timestamp_ntz")


def pairs(df):
    return sorted(((r.l, r.r) for r in df.collect()), key=str)


def test_interval_ends_are_inclusive(spark):
    left = lefts(spark, [(1, 1, 100)])
    right = rights(spark, [(s, 1, s) for s in (89, 90, 100, 105, 106)] + [(200, 2, 100), (201, None, 100)])
    got = J.interval_join(left, right, {"lk": "rk"}, "lts", "rts", "-10 seconds", "5 seconds")
    assert pairs(got) == [(1, 100), (1, 105), (1, 90)]


@pytest.mark.parametrize("how", ["inner", "left", "full"])
@pytest.mark.parametrize("lower,upper", [("-30 seconds", "10 seconds"), ("5 seconds", "6 seconds"), ("0 seconds", "500 milliseconds")])
def test_interval_join_against_all_pairs(spark, how, lower, upper):
    rng = random.Random(3)
    ls = [(i, 1 if rng.random() < 0.4 else rng.randint(2, 4), rng.randint(-100, 100)) for i in range(60)]
    rs = [(i, 1 if rng.random() < 0.4 else rng.randint(2, 4), rng.randint(-100, 100)) for i in range(60)]
    span = {"-30 seconds": (-30, 10), "5 seconds": (5, 6), "0 seconds": (0, 0.5)}[lower]
    # Around the epoch too, where bucket numbers change sign.
    zero = datetime(1970, 1, 1)
    left = spark.createDataFrame([(i, k, zero + timedelta(seconds=s)) for i, k, s in ls], "l long, lk int, lts timestamp_ntz")
    right = spark.createDataFrame([(i, k, zero + timedelta(seconds=s)) for i, k, s in rs], "r long, rk int, rts timestamp_ntz")
    want = [(i, j) for i, k, s in ls for j, k2, s2 in rs if k == k2 and s + span[0] <= s2 <= s + span[1]]
    if how in ("left", "full"):
        want += [(i, None) for i, _, _ in ls if i not in {a for a, _ in want}]
    if how == "full":
        matched = {b for _, b in want}
        want += [(None, j) for j, _, _ in rs if j not in matched]
    got = J.interval_join(left, right, {"lk": "rk"}, "lts", "rts", lower, upper, how)
    assert pairs(got) == sorted(want, key=str)


def test_interval_of_months_is_refused(spark):
    with pytest.raises(ValueError):
        J.interval_join(lefts(spark, [(1, 1, 0)]), rights(spark, [(1, 1, 0)]), {"lk": "rk"}, "lts", "rts", "-1 month", "0 days")


@pytest.mark.parametrize("skew", [Skew(), Skew(0.01, 10, 4, 0)], ids=["whole", "cut"])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_as_of_join_with_ties_deletes_and_a_hot_key(spark, skew, how):
    rng = random.Random(5)
    probes = [(i, None if i == 7 else (1 if rng.random() < 0.5 else rng.randint(2, 4)), rng.randint(0, 60)) for i in range(80)]
    versions = [(i, 1 if rng.random() < 0.5 else rng.randint(2, 4), rng.randint(0, 60)) for i in range(60)]
    v = rights(spark, versions).withColumn("state", (F.col("r") % 5).cast("string"))
    got = J.as_of_join(
        lefts(spark, probes), v, {"lk": "rk"}, "lts", "rts", ["r", "state"], ["r"], deleted=F.col("state") == "0", how=how, skew=skew
    )
    want = []
    for i, k, s in probes:
        known = [(s2, j) for j, k2, s2 in versions if k2 == k and s2 <= s]
        j = max(known)[1] if known else None
        j = None if j is not None and j % 5 == 0 else j
        if j is not None or how == "left":
            want.append((i, j))
    assert pairs(got) == sorted(want, key=str)


def test_validity_join_allows_several_matches(spark):
    left = lefts(spark, [(1, 1, 50), (2, 1, 500), (3, 2, 50)])
    ranges = spark.createDataFrame(
        [(10, 1, at(0), at(50)), (11, 1, at(50), at(90)), (12, 1, at(51), at(90))], "r long, rk int, s timestamp_ntz, e timestamp_ntz"
    )
    want = [(1, 10), (1, 11), (2, None), (3, None)]
    for bucket in (None, "7 seconds"):
        assert pairs(J.validity_join(left, ranges, {"lk": "rk"}, "lts", "s", "e", "left", bucket)) == want


def test_contains_join_against_all_pairs(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab é%_") for _ in range(n))
    texts = [(i, word(rng.randint(0, 30))) for i in range(40)] + [(90, None)]
    names = [(i, word(rng.randint(1, 7))) for i in range(40)] + [(91, None)]
    got = J.contains_join(
        spark.createDataFrame(texts, "l long, t string"), spark.createDataFrame(names, "r long, n string"), "t", "n"
    )
    want = [(i, j) for i, t in texts for j, n in names if t is not None and n is not None and n in t]
    assert pairs(got) == sorted(want, key=str)


def test_reconcile_treats_nulls_as_values(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, None), (4, "q")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (5, "z")], "id int, v string")
    got = {r.id: r.status for r in J.reconcile(a, b, ["id"], {"v": "other value"}).collect()}
    assert got == {1: "same", 2: "same", 3: "other value", 4: "only in legacy", 5: "only in current"}


def test_geofence_with_a_concave_ring(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 5.0), (0.0, 10.0)]
    fences = spark.createDataFrame([(1, ring), (2, [(x + 20, y) for x, y in ring])], "f int, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([("in", 2.0, 3.0), ("notch", 5.0, 8.0), ("right", 29.0, 8.0), ("out", 50.0, 50.0)], "p string, x double, y double")
    inner = J.geofence_join(points, fences, "x", "y", "ring", cell=3.0)
    assert sorted((r.p, r.f) for r in inner.collect()) == [("in", 1), ("right", 2)]
    outer = J.geofence_join(points, fences, "x", "y", "ring", cell=3.0, how="left")
    assert sorted((r.p, r.f) for r in outer.collect() if r.f is None) == [("notch", None), ("out", None)]


def test_repeated_members_add_no_rows(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    members = spark.createDataFrame([(1,), (1,), (None,)], "m int")
    got = J.flag_members(df, members, {"k": "m"}, "hit").collect()
    assert sorted(((r.k, r.hit) for r in got), key=str) == [(1, True), (2, False), (None, False)]


def test_validity_join_with_open_ends_and_a_hot_key(spark):
    rng = random.Random(8)
    far = datetime(9999, 12, 31)
    ranges = [(i, rng.choice([1, 1, 1, 2]), at(rng.randint(-500, 900)), rng.choice([None, far, at(rng.randint(0, 2000))])) for i in range(60)]
    ranges += [(100, 1, datetime(1900, 1, 1), far), (101, 2, at(70), at(60)), (102, None, at(0), far)]
    probes = [(i, rng.choice([1, 1, 2, 3, None]), rng.randint(-600, 2500)) for i in range(80)] + [(90, 1, 100)] * 2
    left = lefts(spark, probes).unionAll(spark.createDataFrame([(99, 1, None)], lefts(spark, probes).schema))
    table = spark.createDataFrame(ranges, "r long, rk int, s timestamp_ntz, e timestamp_ntz")
    hits = lambda k, t: [j for j, rk, s, e in ranges if k is not None and k == rk and t is not None and e is not None and s <= t <= e]
    rows = [(i, k, at(s)) for i, k, s in probes] + [(99, 1, None)]
    for how in ("left", "inner"):
        want = [(i, j) for i, k, t in rows for j in hits(k, t) or ([None] if how == "left" else [])]
        for grain in (None, "1 second", "3 days"):
            assert pairs(J.validity_join(left, table, {"lk": "rk"}, "lts", "s", "e", how, grain)) == sorted(want, key=str)


def test_long_ranges_have_few_nodes_and_are_not_paired_with_all_points(spark):
    """A thousand short ranges and a thousand points of one key: what is joined stays near what matches."""
    ranges = spark.range(1000).select(F.col("id").alias("r"), F.lit(1).alias("rk"), F.timestamp_seconds(F.col("id") * 100).cast("timestamp_ntz").alias("s"))
    ranges = ranges.withColumn("e", F.col("s") + F.expr("interval 150 seconds"))
    points = spark.range(1000).select(F.col("id").alias("l"), F.lit(1).alias("lk"), F.timestamp_seconds(F.col("id") * 100 + 20).cast("timestamp_ntz").alias("lts"))
    joined = J.validity_join(points, ranges, {"lk": "rk"}, "lts", "s", "e", "left", "10 seconds")
    assert joined.count() == 1999
    plan = joined._jdf.queryExecution().toString()
    assert "_up" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_ranges_of_one_length_copy_no_point(spark):
    """Ninety-day ranges, two to nine pieces each: the left side goes to the join once, without copies or a second join."""
    rng = random.Random(4)
    ranges = [(i, rng.choice([1, 2, None]), at(86_400 * rng.randint(0, 400))) for i in range(60)]
    table = spark.createDataFrame(ranges, "r long, rk int, s timestamp_ntz").withColumn("e", F.col("s") + F.expr("interval 90 days"))
    probes = [(i, rng.choice([1, 2, 3, None]), 86_400 * rng.randint(-30, 520)) for i in range(120)]
    left = lefts(spark, probes)
    joined = J.validity_join(left, table, {"lk": "rk"}, "lts", "s", "e", "left", "1 day")
    hits = lambda k, t: [j for j, rk, s in ranges if k is not None and k == rk and s <= t <= s + timedelta(days=90)]
    assert pairs(joined) == sorted([(i, j) for i, k, s in probes for j in hits(k, at(s)) or [None]], key=str)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Generate") == 1 and "Aggregate" not in plan


def test_containment_moves_no_text_and_is_not_misled_by_a_run_of_all_names(spark):
    texts = spark.createDataFrame([(i, f"the common part and name{i:04d} of it") for i in range(300)], "l long, t string")
    names = spark.createDataFrame([(i, f"common part and name{i:04d}") for i in range(300)], "r long, n string")
    got = J.contains_join(texts, names, "t", "n", gram=6)
    assert pairs(got) == sorted([(i, i) for i in range(300)], key=str)
    index = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode(array_distinct(transform" in line]
    assert index and all("[t#" not in line.split("explode")[0] for line in index)
    for line in index:  # the exploded rows hold a checksum and a run
        assert "outer" not in line and "t#" not in line.split("]")[-1]
