"""Streams over several small files, one file per micro-batch."""

import pickle
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.plain import plain_matches
from tidemill.operators import quality as Q
from tidemill.operators import windows as W
from tidemill.operators.ordered import Skew
from tidemill.sources import records, sinks
from tidemill.streaming import event_time as E
from tidemill.streaming import in_order, run, stateful
from tidemill.streaming.late import late_splitter, split_to
from tidemill.streaming.patterns import stream_match_rows

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, k int, ts timestamp_ntz, v double"


def at(s):
    return T0 + timedelta(seconds=s)


def files(spark, path, *batches, schema=SCHEMA):
    """One parquet file per batch, in order of arrival."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b{n}")
        time.sleep(0.02)
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .parquet(str(path))
    )


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def ntz(df):
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def test_window_is_emitted_once_when_it_closes(spark, tmp_path):
    s = files(spark, tmp_path / "in", [(1, 1, at(1), 1.0), (2, 1, at(5), 2.0)], [(3, 1, at(9), 4.0)], [(4, 1, at(16), 8.0)])
    agg = W.tumble_agg(E.bounded_out_of_orderness(s, "ts", 5000), "ts", "10 seconds", ["k"], F.sum("v").alias("s"))
    assert rows(ntz(run.append_to(agg, str(tmp_path / "out"))), "window_start", "s") == [(T0, 7.0)]


def test_row_behind_the_watermark_is_dropped(spark, tmp_path):
    s = files(spark, tmp_path / "in", [(1, 1, at(1), 1.0)], [(2, 1, at(60), 2.0)], [(3, 1, at(62), 2.0)], [(4, 1, at(3), 100.0)], [(5, 1, at(120), 0.0)])
    agg = W.tumble_agg(E.bounded_out_of_orderness(s, "ts", 5000), "ts", "10 seconds", ["k"], F.sum("v").alias("s"))
    assert rows(ntz(run.append_to(agg, str(tmp_path / "out"))), "window_start", "s") == [(T0, 1.0), (at(60), 4.0)]


def test_allowed_lateness_revises_a_window(spark, tmp_path):
    s = files(spark, tmp_path / "in", [(1, 1, at(1), 1.0)], [(2, 1, at(60), 2.0)], [(3, 1, at(3), 100.0)])
    late = E.bounded_out_of_orderness(s, "ts", 5000, lateness_ms=600_000)
    agg = W.tumble_agg(late, "ts", "10 seconds", ["k"], F.sum("v").alias("s"))
    got = run.update_to(agg, str(tmp_path / "out"), ["window_start", "k"])
    assert rows(ntz(got), "window_start", "s") == [(T0, 101.0), (at(60), 2.0)]


def test_sub_second_delay_is_kept(spark, tmp_path):
    """A delay of 500 ms is not rounded to none, nor 0 to the default."""
    s = files(spark, tmp_path / "in", [(1, 1, at(1), 1.0)])
    plan = E.bounded_out_of_orderness(s, "ts", 500)._jdf.queryExecution().analyzed().toString()
    assert "0.5 seconds" in plan
    assert "0 seconds" in E.monotonously_increasing(s, "ts")._jdf.queryExecution().analyzed().toString()


def test_duplicates_across_batches(spark, tmp_path):
    s = files(spark, tmp_path / "in", [(1, 1, at(1), 1.0), (1, 1, at(1), 1.0), (2, 1, at(2), 1.0)], [(1, 1, at(4), 1.0), (3, 1, at(4), 1.0)])
    once = E.deduplicate(s, ["id"], "ts", 60_000).select("id")
    assert rows(run.append_to(once, str(tmp_path / "out")), "id") == [(1,), (2,), (3,)]


@pytest.mark.parametrize("how", ["leftOuter", "fullOuter"])
def test_outer_interval_join_emits_the_unmatched(spark, tmp_path, how):
    left = files(spark, tmp_path / "l", [(1, 1, at(0), 0.0), (2, 1, at(100), 0.0)], [(3, 1, at(500), 0.0)], [(4, 1, at(900), 0.0)])
    right = files(spark, tmp_path / "r", [(11, 1, at(5), 0.0), (12, 1, at(300), 0.0)], [(13, 1, at(505), 0.0)], [(14, 1, at(900), 0.0)])
    a = E.bounded_out_of_orderness(left, "ts", 1000).select(F.col("id").alias("l"), F.col("k").alias("lk"), F.col("ts").alias("lts"))
    b = E.bounded_out_of_orderness(right, "ts", 1000).select(F.col("id").alias("r"), F.col("k").alias("rk"), F.col("ts").alias("rts"))
    j = a.join(b, F.expr("lk = rk AND rts BETWEEN lts AND lts + interval 10 seconds"), how).select("l", "r")
    want = [(1, 11), (2, None), (3, 13), (4, 14)] + ([(None, 12)] if how == "fullOuter" else [])
    assert rows(run.append_to(j, str(tmp_path / "out")), "l", "r") == sorted(want, key=str)


def test_monitor_is_stateless(spark, tmp_path):
    s = files(spark, tmp_path / "in", [(1, None, at(1), 1.0)], [(2, 1, at(1), -5.0)])
    checks = [*Q.not_null("k"), *Q.positive("v")]
    bad = Q.violations(s, "t", checks, F.expr("timestamp_ntz'2024-02-01'"))
    assert rows(run.append_to(bad, str(tmp_path / "out")), "violation_type") == [("not_null:k",), ("positive:v",)]


def test_json_stream_to_json_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    s = records.parse_json_records(spark.readStream.text(str(tmp_path / "in")), "id int")
    good = s.where("id is not null")
    sinks.append(sinks.to_messages(good, "id").drop("key"), "text", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.text(str(tmp_path / "out")), "value") == [('{"id":1}',), ('{"id":2}',)]


def test_restart_goes_on_where_it_stopped(spark, tmp_path):
    s = files(spark, tmp_path / "in", [(1, 1, at(1), 1.0)])
    assert run.append_to(s.select("id"), str(tmp_path / "out")).count() == 1
    spark.createDataFrame([(2, 1, at(1), 1.0)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / "later"))
    assert rows(run.append_to(s.select("id"), str(tmp_path / "out")), "id") == [(1,), (2,)]


def test_settings_are_restored(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with run.settings(spark, **run.state_settings("rocksdb", parallelism=3)):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_totals_with_ttl(spark, tmp_path):
    s = files(spark, tmp_path / "in", [(1, 1, at(0), 1.0), (2, 2, at(0), 5.0)], [(3, 1, at(0), 2.0)])
    conf = run.state_settings("rocksdb", 2) | {"spark__sql__streaming__noDataMicroBatches__enabled": "false"}
    with run.settings(spark, **conf):
        got = run.update_to(stateful.totals_with_ttl(s, ["k"], "v", 3_600_000), str(tmp_path / "out"), ["k"], timeout=300)
    assert rows(got, "k", "n", "total") == [(1, 2, 3.0), (2, 1, 5.0)]


def test_expired_state_starts_again(spark, tmp_path):
    """With a TTL shorter than the time between batches nothing is remembered."""
    s = files(spark, tmp_path / "in", [(1, 1, at(0), 1.0)], [(3, 1, at(0), 2.0)])
    conf = run.state_settings("rocksdb", 2) | {"spark__sql__streaming__noDataMicroBatches__enabled": "false"}
    with run.settings(spark, **conf):
        got = run.update_to(stateful.totals_with_ttl(s, ["k"], "v", 1), str(tmp_path / "out"), ["k"], timeout=300)
    assert rows(got, "k", "n", "total") == [(1, 1, 2.0)]


def test_ttl_must_be_positive(spark):
    with pytest.raises(ValueError):
        stateful.totals_with_ttl(spark.range(1), ["id"], "id", 0)


@pytest.mark.parametrize("skew", [Skew(), Skew(share=0.01, min_rows=2, oversplit=2, min_bytes=0)])
def test_late_rows_across_batches(spark, tmp_path, skew):
    batches = [[(1, 1, at(100), 0.0), (2, 1, at(95), 0.0), (3, 1, at(80), 0.0)], [(4, 1, at(89), 0.0), (5, 1, at(200), 0.0), (6, 2, at(0), 0.0), (7, 1, at(189), 0.0), (8, None, at(5), 0.0), (9, 1, None, 0.0)], [(10, None, at(-6), 0.0), (11, 2, at(1), 0.0)]]
    s = files(spark, tmp_path / "in", *batches)
    on_time, late = split_to(s, "k", "ts", "id", 10_000, str(tmp_path / "out"), timeout=300, skew=skew)
    got = on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    want = [(1, False), (2, False), (3, True), (4, True), (5, False), (6, False), (7, True), (8, False), (9, False), (10, True), (11, False)]
    assert rows(got, "id", "late") == sorted(want, key=str)
    # The batch replay agrees.
    replay = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    on_time, late = E.split_late(replay, "ts", ["k"], "id", 10_000)
    assert sorted([(r.id, False) for r in on_time.collect()] + [(r.id, True) for r in late.collect()]) == want


def test_stream_as_of_join_finds_versions_that_come_late(spark, tmp_path):
    rng = random.Random(6)
    probes = [(i, rng.randint(1, 3), at(rng.randint(0, 50)), 0.0) for i in range(30)]
    versions = [(100 + i, rng.randint(1, 3), at(rng.randint(0, 50)), float(i)) for i in range(20)]
    end = [(i, k, at(1000), 0.0) for i, k in ((900, 1), (901, 2), (902, 3))]
    # Versions reach the query in the second batch, within the allowed delay.
    p = files(spark, tmp_path / "p", probes, end)
    v = files(spark, tmp_path / "v", [], versions, [(999, 1, at(1000), 0.0)])
    with run.settings(spark, **run.state_settings("rocksdb", 2)):
        joined = in_order.stream_as_of_join(p, v.withColumnsRenamed({"id": "vid", "k": "vk", "ts": "vts", "v": "state"}), ("k", "vk"), "ts", "vts", ["vid", "state"], "vid", 100_000)
        got = run.append_to(joined, str(tmp_path / "out"), timeout=300)
    want = []
    for i, k, ts, _ in probes:
        known = [(vts, vid) for vid, vk, vts, _ in versions if vk == k and vts <= ts]
        want.append((i, ts, max(known)[1] if known else None))
    assert rows(got.where("id < 900"), "id", "ts", "vid") == sorted(want, key=str)


def test_fan_out_reads_the_batch_once(spark, tmp_path):
    s = files(spark, tmp_path / "in", [(1, 1, at(0), 1.0), (2, 2, at(0), 9.0)])
    out = str(tmp_path / "out")
    write = sinks.fan_out({"big": lambda b: b.where("v > 5"), "all": lambda b: b}, lambda df, n, i: df.write.mode("overwrite").parquet(f"{out}/{n}/{i}"))
    s.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{out}/big/0").count() == 1 and spark.read.parquet(f"{out}/all/0").count() == 2


@pytest.mark.parametrize("within", [None, 12_000])
def test_pattern_over_rows_out_of_order_and_across_batches(spark, tmp_path, within):
    rng = random.Random(8)
    data = [(i, rng.randint(1, 2), at(rng.randint(0, 300)), float(rng.randint(0, 3))) for i in range(90)]
    end = [(900, 1, at(5000), 3.0), (901, 2, at(5000), 3.0)]
    s = files(spark, tmp_path / "in", data[:30], data[30:60], data[60:], end, [(990, 1, at(9000), 3.0)])
    v = F.col("v")
    with run.settings(spark, **run.state_settings("rocksdb", 2)):
        m = stream_match_rows(s, "k", "ts", "id", [("A", "+"), ("B", "?"), ("C", "")], {"A": v == 0, "B": v == 1, "C": v == 2}, 1_000_000, within)
        m = m.select("k", F.transform("match", lambda r: F.concat(r["variable"], r["row"]["id"])).alias("m"))
        got = run.append_to(m, str(tmp_path / "out"), timeout=300)
    want = []
    for k in (1, 2):
        mine = sorted((ts, i, "ABCx"[int(x)]) for i, kk, ts, x in data if kk == k)
        want += [(k, [f"{x}{i}" for _, i, x in hit]) for hit in plain_matches(mine, "A+B?C", within)]
    assert rows(got, "k", "m") == sorted(want, key=str)


@pytest.mark.parametrize("offset", [1, 2])
def test_lag_over_rows_out_of_order_and_across_batches(spark, tmp_path, offset):
    rng = random.Random(3)
    data = [(i, rng.randint(1, 2), at(rng.randint(0, 60)), float(i)) for i in range(40)]
    s = files(spark, tmp_path / "in", data[:20], data[20:], [(900, 1, at(500), 0.0), (901, 2, at(500), 0.0)], [(902, 1, at(2000), 0.0)])
    with run.settings(spark, **run.state_settings("rocksdb", 2)):
        lagged = in_order.stream_lag(s, "k", "ts", "id", 100_000, offset).select("id", F.col("previous.id").alias("before"))
        got = run.append_to(lagged, str(tmp_path / "out"), timeout=300).where("id < 900")
    want = []
    for k in (1, 2):
        mine = [i for _, i in sorted((ts, i) for i, kk, ts, _ in data if kk == k)]
        want += list(zip(mine, [None] * offset + mine))
    assert rows(got, "id", "before") == sorted(want, key=str)


class _Counted:
    """State in memory that counts calls."""

    def __init__(self):
        self.calls, self.value, self.parts, self.timers = 0, None, {}, set()

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {
                "exists": lambda: self.value is not None,
                "get": lambda: self.value,
                "update": lambda v: setattr(self, "value", v),
                "clear": lambda: setattr(self, "value", None),
                "updateValue": lambda k, v: self.parts.__setitem__(k, v),
                "getValue": lambda k: self.parts[k],
                "removeKey": lambda k: self.parts.pop(k),
                "registerTimer": self.timers.add,
                "deleteTimer": self.timers.remove,
            }[name](*args)

        return call


class _Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


@pytest.mark.parametrize("loose", [4, 16, 4096])
@pytest.mark.parametrize("batches", [1, 5, 60])
def test_rows_in_order_with_few_calls_into_the_state(loose, batches):
    """Rows spread over a month, in any order and a few late: all handed on, in order of time, few calls a row."""
    rng = random.Random(loose + batches)
    month, start = 30 * 86_400_000, 1_704_067_200_000
    kinds = T.StructType([T.StructField(n, T.LongType()) for n in ("us", "rank", "tie")])
    line = sorted(rng.randrange(start * 1000, (start + month) * 1000) for _ in range(1500))
    sent = [Row(us=us, rank=0, tie=i) for us, i in sorted(((us, i) for i, us in enumerate(line)), key=lambda r: r[0] + rng.randrange(40 * 3_600_000_000))]
    p = in_order.InOrder(kinds, loose_rows=loose)
    state = _Counted()
    p.handle = p.waiting = p.parts = state
    p.advance = lambda key, rows: [(r["us"],) for r in rows]
    now = top = 0
    got = []

    def fire():
        for at in sorted(t for t in state.timers if t <= now):
            got.extend(u for out in p.handleExpiredTimer(("k",), _Now(now), None) for (u,) in pickle.loads(out.rows))
            state.timers.remove(at)

    size = -(-len(sent) // batches)
    for a in range(0, len(sent), size):
        p.handleInputRows(("k",), sent[a : a + size], _Now(now))
        fire()
        top = max([top, *(r.us // 1000 for r in sent[a : a + size])])
        now = max(now, top - 40 * 3_600_000)
        fire()
    now = start + month + 1
    fire()
    assert got == line and state.value is None and not state.parts and not state.timers
    if loose == in_order.LOOSE_ROWS:
        assert state.calls < len(sent)  # one bucket a row took some ten


def test_a_repeated_batch_marks_the_same_rows(spark, tmp_path):
    write = late_splitter("k", "ts", "id", 10_000, str(tmp_path))
    first, second = (spark.createDataFrame(b, SCHEMA) for b in ([(1, 1, at(100), 0.0)], [(2, 1, at(80), 0.0), (3, 1, at(300), 0.0)]))
    for batch, n in ((first, 0), (second, 1), (second, 1)):
        write(batch, n)
    assert rows(spark.read.parquet(str(tmp_path / "late")), "id") == [(2,)]
    assert rows(spark.read.parquet(str(tmp_path / "rows")), "id") == [(1,), (3,)]


def test_distinct_counts_of_windows_across_batches(spark, tmp_path):
    rng = random.Random(3)
    data = [(i, rng.choice([None, 1, 2]), at(rng.randint(0, 200)), rng.choice([None, 1.0, 2.0, 3.0])) for i in range(90)]
    s = files(spark, tmp_path / "in", data[:30], data[30:60], data[60:], [(900, 9, at(5000), 0.0)], [(901, 9, at(9000), 0.0)])
    with run.settings(spark, **run.state_settings("rocksdb", 2)):
        out = E.distinct_per_window(s, "ts", "60 seconds", ["k"], "v", "n", delay_ms=1_000_000, slide="20 seconds")
        got = run.append_to(out, str(tmp_path / "out"), timeout=300)
    batch = W.hop_distinct(spark.createDataFrame(data, SCHEMA), "ts", "60 seconds", "20 seconds", ["k"], "v", "n")
    want = rows(batch, "k", "window_start", "n")
    assert rows(ntz(got).where("window_start < '2024-01-01 01:00:00'"), "k", "window_start", "n") == want


def test_a_stream_that_skips_what_is_there(spark, tmp_path):
    spark.createDataFrame([(1, 1, at(0), 0.0)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in/b0"))
    time.sleep(1.1)
    since = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    time.sleep(1.1)
    s = files(spark, tmp_path / "in/later", [(2, 1, at(0), 0.0)])
    both = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    assert rows(run.append_to(records.skip_backlog(both, since).select("id"), str(tmp_path / "a")), "id") == [(2,)]
    assert rows(run.append_to(records.skip_backlog(s).select("id"), str(tmp_path / "b")), "id") == []
