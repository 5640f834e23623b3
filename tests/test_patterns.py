"""Row patterns against a plain reading of the rule, one key at a time."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.plain import plain_matches
from tidemill.operators import patterns as P
from tidemill.operators.ordered import Skew

T0 = datetime(2024, 1, 1)
CUT = Skew(0.01, 20, 4, 0)


def frame(spark, letters, key=1, gap=60):
    rows = [(i, key, T0 + timedelta(seconds=gap * i), x, float(i)) for i, x in enumerate(letters)]
    return spark.createDataFrame(rows, "id long, k int, ts timestamp_ntz, x string, v double")


def letters_of(*names):
    return {n: F.col("x") == n for n in names}


def found(df, pattern, define, **kw):
    m = P.match_rows(df, ["k"], "ts", pattern, define, ties=["id"], **kw)
    out = m.select("k", F.transform("match", lambda r: F.concat(r["variable"], r["row"]["id"].cast("string"))).alias("m"))
    return sorted((r.k, tuple(r.m)) for r in out.collect())


@pytest.mark.parametrize(
    "pattern,text,want",
    [
        ([("A", ""), ("B", "")], "AABAB", [("A1", "B2"), ("A3", "B4")]),
        ([("A", "+"), ("B", "")], "AABAB", [("A0", "A1", "B2"), ("A3", "B4")]),
        ([("A", "*"), ("B", "")], "BAB", [("B0",), ("A1", "B2")]),
        ([("A", "?"), ("B", "")], "AAB", [("A1", "B2")]),
        ([("A", "{2}")], "AAAAA", [("A0", "A1"), ("A2", "A3")]),
        ([("A", "{2,3}"), ("B", "")], "AAAAB", [("A1", "A2", "A3", "B4")]),
        ([("A", "{2,}")], "ABAAA", [("A2", "A3", "A4")]),
        ([("A", ""), ("B", "*"), ("C", "")], "ACABBC", [("A0", "C1"), ("A2", "B3", "B4", "C5")]),
        ([("A", ""), ("B", "")], "AxB", []),
        ([("A", "*")], "xAAx", [("A1", "A2")]),
        ([("A", "")], "xyz", []),
    ],
)
def test_quantifiers(spark, pattern, text, want):
    got = found(frame(spark, text), pattern, letters_of("A", "B", "C"))
    assert got == sorted((1, m) for m in want)


def test_a_row_may_satisfy_several_variables(spark):
    """Greedy with give-back: S takes all it can while E, true everywhere, still gets a row."""
    got = found(frame(spark, "AAAA"), [("S", "+"), ("E", "")], {"S": F.col("x") == "A"})
    assert got == [(1, ("S0", "S1", "S2", "E3"))]


def test_bad_patterns_are_refused(spark):
    with pytest.raises(ValueError):
        P.match_rows(frame(spark, "A"), ["k"], "ts", [("A", "+?")], {})
    with pytest.raises(ValueError):
        P.match_rows(frame(spark, "A"), ["k"], "ts", [(c, "") for c in "ABCDEFG"], {})


def test_within(spark):
    df = frame(spark, "AB", key=1).unionByName(frame(spark, "AB", key=2, gap=3600))
    pattern = [("A", ""), ("B", "")]
    assert found(df, pattern, letters_of("A", "B"), within="60 seconds") == [(1, ("A0", "B1"))]


def test_measures(spark):
    m = P.match_rows(frame(spark, "AABx"), ["k"], "ts", [("A", "+"), ("B", ""), ("C", "*")], letters_of("A", "B", "C"), ties=["id"])
    row = P.one_row_per_match(
        m,
        ["k"],
        first=P.first_of("A", "v"),
        last=P.last_of("A", "v"),
        n=P.count_of("A"),
        total=P.sum_of(None, "v"),
        none=P.last_of("C", "v"),
    ).first()
    assert (row.first, row.last, row.n, row.total, row.none) == (0.0, 1.0, 2, 3.0, None)
    rows = P.all_rows_per_match(m, "ts").orderBy("id").collect()
    assert [(r.classifier, r.id, r.match_start) for r in rows] == [("A", 0, T0), ("A", 1, T0), ("B", 2, T0)]


@pytest.mark.parametrize("skew", [Skew(), CUT], ids=["whole", "cut"])
@pytest.mark.parametrize("within", [None, 3])
def test_random_rows_with_a_hot_key(spark, skew, within):
    rng = random.Random(9)
    rows = [(i, 1 if rng.random() < 0.6 else rng.randint(2, 4), T0 + timedelta(seconds=rng.randint(0, 200)), rng.choice("AABCx"), 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k int, ts timestamp_ntz, x string, v double")
    want = []
    for k in (1, 2, 3, 4):
        mine = sorted((ts, i, x) for i, kk, ts, x, _ in rows if kk == k)
        hits = plain_matches(mine, "A+B{1,2}C?", within and within * 1000)
        want += [(k, tuple(f"{x}{i}" for _, i, x in hit)) for hit in hits]
    span = {"within": f"{within} seconds"} if within else {}
    got = found(df, [("A", "+"), ("B", "{1,2}"), ("C", "?")], letters_of("A", "B", "C"), skew=skew, **span)
    assert got == sorted(want)


@pytest.mark.parametrize("skew", [Skew(), CUT], ids=["whole", "cut"])
def test_rising_runs_with_a_hot_key(spark, skew):
    rng = random.Random(4)
    rows = [(i, 1 if rng.random() < 0.6 else 2, T0 + timedelta(seconds=i // 2), "x", float(rng.randint(0, 9))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k int, ts timestamp_ntz, x string, v double")
    m = P.match_rows(
        df,
        ["k"],
        "ts",
        [("A", ""), ("B", "+")],
        {"B": F.col("v") > F.col("prev")},
        ties=["id"],
        lookback={"prev": lambda w: F.lag("v").over(w)},
        skew=skew,
    )
    got = sorted(tuple(r.ids) for r in m.select(F.transform("match", lambda r: r["row"]["id"]).alias("ids")).collect())
    want = []
    for k in (1, 2):
        run = []
        for i, _, _, _, v in [r for r in rows if r[1] == k] + [(None, k, None, None, float("-inf"))]:
            if run and v > run[-1][1]:
                run.append((i, v))
            else:
                if len(run) > 1:
                    want.append(tuple(x for x, _ in run))
                run = [(i, v)]
    assert got == sorted(want)
