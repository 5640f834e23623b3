import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemill.operators import frames
from tidemill.operators import windows as W
from tidemill.operators.ordered import Skew

T0 = datetime(2024, 1, 1)


def frame(spark, *rows):
    return spark.createDataFrame([(k, T0 + timedelta(seconds=s), float(v)) for k, s, v in rows], "k string, ts timestamp_ntz, v double")


def aggs():
    return {"n": (F.count("*"), F.sum), "total": (F.sum("v"), F.sum)}


def out(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def at(s):
    return T0 + timedelta(seconds=s)


def test_five_events_in_one_window(spark):
    df = frame(spark, *[("a", i, 100 + 10 * i) for i in range(5)])
    got = W.tumble_agg(df, "ts", "10 seconds", [], F.count("*").alias("n"), F.sum("v").alias("s"))
    assert out(got, "window_start", "window_end", "n", "s") == [(T0, at(10), 5, 600.0)]


def test_window_end_is_exclusive(spark):
    got = W.tumble_agg(frame(spark, ("a", 9, 1), ("a", 10, 1)), "ts", "10 seconds", [], F.count("*").alias("n"))
    assert out(got, "window_start", "n") == [(T0, 1), (at(10), 1)]


def test_row_form_has_window_time(spark):
    got = W.tumble(frame(spark, ("a", 3, 1)), "ts", "10 seconds")
    assert out(got, "window_start", "window_end", "window_time") == [(T0, at(10), at(10) - timedelta(milliseconds=1))]


def test_hop_plans_agree(spark):
    df = frame(spark, *[("ab"[i % 2], i * 7, i) for i in range(60)])
    plain = W.hop_agg(df, "ts", "60 seconds", "10 seconds", ["k"], F.count("*").alias("n"), F.sum("v").alias("total"))
    panes = W.hop_panes(df, "ts", "60 seconds", "10 seconds", ["k"], aggs())
    cols = ("k", "window_start", "window_end", "n", "total")
    assert out(plain, *cols) == out(panes, *cols)


@pytest.mark.parametrize(("size", "slide"), [("10 seconds", "4 seconds"), ("5 seconds", "3 seconds"), ("4 seconds", "10 seconds")])
def test_hop_panes_of_any_size_and_slide(spark, size, slide):
    df = frame(spark, *[("ab"[i % 2], i * 3, i) for i in range(60)])
    cols = ("k", "window_start", "window_end", "n", "total")
    try:
        plain = out(W.hop_agg(df, "ts", size, slide, ["k"], F.count("*").alias("n"), F.sum("v").alias("total")), *cols)
    except AnalysisException:  # a slide above the size is no window of Spark's; both forms say so
        with pytest.raises(AnalysisException):
            out(W.hop_panes(df, "ts", size, slide, ["k"], aggs()), *cols)
    else:
        assert out(W.hop_panes(df, "ts", size, slide, ["k"], aggs()), *cols) == plain


def test_cumulate_needs_whole_steps(spark):
    df = frame(spark, ("a", 1, 1))
    for make in (lambda: W.cumulate(df, "ts", "3 seconds", "10 seconds"), lambda: W.cumulate_panes(df, "ts", "3 seconds", "10 seconds", ["k"], aggs())):
        with pytest.raises(ValueError, match="multiple"):
            make()


@pytest.mark.parametrize("second", [30, 31])
def test_session_gap_edge(spark, second):
    """Events exactly a gap apart share a session; a second more parts them."""
    df = frame(spark, ("a", 0, 1), ("a", second, 2), ("b", 5, 9))
    native = W.session_agg(df, "ts", "30 seconds", ["k"], F.count("*").alias("n"), F.sum("v").alias("total"))
    panes = W.session_panes(df, "ts", "30 seconds", ["k"], aggs())
    cols = ("k", "window_start", "window_end", "n", "total")
    assert out(native, *cols) == out(panes, *cols)
    assert native.where("k = 'a'").count() == (1 if second == 30 else 2)


def test_sessions_from_panes_on_many_rows(spark):
    df = frame(spark, *[("abc"[i % 3], (i * i * 13) % 5000, i) for i in range(300)])
    cols = ("k", "window_start", "window_end", "n", "total")
    native = W.session_agg(df, "ts", "20 seconds", ["k"], F.count("*").alias("n"), F.sum("v").alias("total"))
    assert out(native, *cols) == out(W.session_panes(df, "ts", "20 seconds", ["k"], aggs()), *cols)


def test_cumulate_fills_steps_without_rows(spark):
    df = frame(spark, ("a", 1, 1), ("a", 25, 2))
    got = W.cumulate_panes(df, "ts", "10 seconds", "40 seconds", ["k"], aggs())
    assert out(got, "window_end", "n", "total") == [(at(10), 1, 1.0), (at(20), 1, 1.0), (at(30), 2, 3.0), (at(40), 2, 3.0)]
    rows = W.cumulate(df, "ts", "10 seconds", "40 seconds").groupBy("window_end").agg(F.count("*").alias("n"))
    assert out(rows, "window_end", "n") == [(at(10), 1), (at(20), 1), (at(30), 2), (at(40), 2)]


def test_cumulate_starts_at_the_first_step_with_rows(spark):
    got = W.cumulate_panes(frame(spark, ("a", 35, 1)), "ts", "10 seconds", "40 seconds", ["k"], aggs())
    assert out(got, "window_end") == [(at(40),)]


def test_empty_input(spark):
    empty = frame(spark, ("a", 0, 1)).where("false")
    assert W.session_panes(empty, "ts", "1 minute", ["k"], aggs()).count() == 0
    assert W.cumulate_panes(empty, "ts", "1 minute", "1 hour", ["k"], aggs()).count() == 0


def test_null_key_is_a_group(spark):
    got = W.session_panes(frame(spark, (None, 0, 1), (None, 5, 2)), "ts", "10 seconds", ["k"], aggs())
    assert out(got, "k", "n") == [(None, 2)]


def test_intervals_are_read_without_spark():
    assert W.micros_of("1 hour 30 minutes") == 5_400_000_000 and W.micros_of("2 DAYS") == 2 * W.micros_of("24 hours")
    for bad in ("1 month", "soon", "", "1 hour and a bit"):
        with pytest.raises(ValueError):
            W.micros_of(bad)


@pytest.mark.parametrize(("size", "slide"), [("60 seconds", "10 seconds"), ("10 seconds", "4 seconds"), ("20 seconds", "20 seconds")])
def test_distinct_counts_over_hops_equal_the_expansion(spark, size, slide):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), T0 + timedelta(seconds=rng.randint(-300, 300)), rng.choice([1.0, 2.0, 3.0, None])) for _ in range(200)]
    df = spark.createDataFrame([*rows, ("z", T0, None), ("a", None, 5.0)], "k string, ts timestamp_ntz, v double")
    plain = W.hop_agg(df, "ts", size, slide, ["k"], F.count_distinct("v").alias("n"))
    gaps = W.hop_distinct(df, "ts", size, slide, ["k"], "v", "n")
    cols = ("k", "window_start", "window_end", "n")
    key = lambda r: str(r)
    assert sorted(map(tuple, gaps.select(*cols).collect()), key=key) == sorted(map(tuple, plain.select(*cols).collect()), key=key)
    assert "Expand" not in gaps._jdf.queryExecution().executedPlan().toString()


def test_hop_panes_sort_panes_and_not_windows(spark):
    """Windows are made behind the only sort and the last shuffle, whatever their number."""
    df = frame(spark, *[("ab"[i % 2], i * 7, i) for i in range(60)])
    panes = W.hop_panes(df, "ts", "60 seconds", "1 second", ["k"], aggs())
    plan = panes._jdf.queryExecution().sparkPlan().toString().splitlines()
    made = next(i for i, line in enumerate(plan) if "Generate explode(sequence" in line)
    assert not any("Window" in line or "Exchange" in line for line in plan[:made])
    done = panes._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert done.count("Sort [") == 1 and done.count("Exchange") == 2
    plain = W.hop_agg(df, "ts", "60 seconds", "1 second", ["k"], F.count("*").alias("n"), F.sum("v").alias("total"))
    cols = ("k", "window_start", "window_end", "n", "total")
    assert out(panes, *cols) == out(plain, *cols)


def test_hop_panes_with_nulls_and_gaps(spark):
    rows = [(None, T0 + timedelta(seconds=s), v) for s, v in ((0, 1.0), (500, None), (505, 2.0), (-70, 3.0))] + [("a", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    plain = W.hop_agg(df, "ts", "60 seconds", "10 seconds", ["k"], F.count("*").alias("n"), F.sum("v").alias("total"))
    cols = ("window_start", "window_end", "n", "total")
    assert out(W.hop_panes(df, "ts", "60 seconds", "10 seconds", ["k"], aggs()), *cols) == out(plain, *cols)


def test_sessions_for_any_aggregate(spark):
    rng = random.Random(2)
    df = frame(spark, *[(rng.choice("aab"), rng.randint(0, 4000), rng.randint(0, 4)) for _ in range(300)]).unionAll(
        spark.createDataFrame([(None, T0, 1.0), (None, at(5), 1.0), ("a", None, 9.0)], "k string, ts timestamp_ntz, v double")
    )
    native = W.session_agg(df.where("ts is not null"), "ts", "20 seconds", ["k"], F.count_distinct("v").alias("kinds"), F.count("*").alias("n"))
    rows = W.session(df, "ts", "20 seconds", ["k"]).groupBy("k", "window_start", "window_end").agg(F.count_distinct("v").alias("kinds"), F.count("*").alias("n"))
    cols = ("k", "window_start", "window_end", "kinds", "n")
    assert sorted(map(tuple, rows.select(*cols).collect()), key=str) == sorted(map(tuple, native.select(*cols).collect()), key=str)


def _framed(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


FRAME_AGGS = {"s": ("sum", "v"), "n": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v")}


@pytest.mark.parametrize("pieces", [1, 3, 16])
@pytest.mark.parametrize("seconds", [0, 1, 7, 60, 10_000])
def test_range_frames_equal_the_plain_frame(spark, seconds, pieces):
    rng = random.Random(seconds)
    rows = [(i, rng.choice(["a", "a", None]), None if rng.random() < 0.05 else at(rng.randint(-100, 300)), rng.choice([None, 1.0, 2.5, -4.0])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v double")
    aggs = {name: (kind, F.col(c)) for name, (kind, c) in FRAME_AGGS.items()}
    got = frames.range_frame(df, ["k"], "ts", f"{seconds} seconds", aggs, pieces)
    over = f"over (partition by k order by ts range between interval '{seconds}' second preceding and current row)"
    want = df.select("id", *[F.expr(f"{kind}(v) {over}").alias(name) for name, (kind, _) in FRAME_AGGS.items()])
    assert _framed(got, "id", "s", "n", "lo", "hi") == _framed(want, "id", "s", "n", "lo", "hi")


@pytest.mark.parametrize("rows_back", [0, 1, 5, 40, 1000])
def test_long_row_frames_equal_the_plain_frame(spark, rows_back):
    rng = random.Random(rows_back)
    rows = [(i, rng.choice(["a", "a", None]), at(rng.randint(0, 50)), rng.choice([None, 1.0, 2.5, -4.0])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v double")
    aggs = {name: (kind, F.col(c)) for name, (kind, c) in FRAME_AGGS.items()}
    want = df.select("id", *[F.expr(f"{k}(v) over (partition by k order by ts, id rows between {rows_back} preceding and current row)").alias(n) for n, (k, _) in FRAME_AGGS.items()])
    for skew in (Skew(), Skew(share=0.01, min_rows=10, oversplit=2, min_bytes=0)):
        got = frames.row_frame(df, ["k"], "ts", rows_back, aggs, ties=["id"], pieces=4, skew=skew)
        assert _framed(got, "id", "s", "n", "lo", "hi") == _framed(want, "id", "s", "n", "lo", "hi")


def test_a_frame_deals_one_key_by_time(spark):
    df = spark.range(4000).select(F.lit("a").alias("k"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("v"))
    plan = frames.range_frame(df, ["k"], "ts", "1000 seconds", {"s": ("sum", F.col("v"))})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(k#") >= 1 and "_in#" in plan
    for line in plan.splitlines():  # only rows per bucket are ever dealt by key alone
        if "Exchange hashpartitioning(k#" in line and "_in#" not in line and "_b#" not in line:
            assert line.split("hashpartitioning(")[1].count("#") == 1
