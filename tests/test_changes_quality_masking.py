from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators import cdc as C
from tidemill.operators import joins as J
from tidemill.operators import masking as M
from tidemill.operators import quality as Q
from tidemill.operators import routing as R
from tidemill.sources import records, sinks

T0 = datetime(2024, 1, 1)
AT = "timestamp_ntz'2024-02-01 00:00:00'"


# -- change data --------------------------------------------------------------


def test_delete_hides_older_versions(spark):
    df = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", True), (2, 1, "c", False)], "id int, v int, x string, gone boolean")
    live = C.latest_per_key(df, ["id"], ["v"], F.col("gone"))
    assert [tuple(r) for r in live.collect()] == [(2, 1, "c", False)]
    assert live.columns == df.columns


def test_latest_keeps_null_values_of_the_newest_row(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None)], "id int, v int, x string")
    assert C.latest_per_key(df, ["id"], ["v"]).first().x is None


def test_unwrap_changes(spark):
    rows = [
        '{"op":"c","before":null,"after":{"id":1,"x":"a"},"ts_ms":1000}',
        '{"op":"d","before":{"id":1,"x":"a"},"after":null,"ts_ms":2000}',
        '{"op":"r","before":null,"after":{"id":2,"x":null},"ts_ms":1}',
        "null",
        "broken",
    ]
    got = C.unwrap_changes(spark.createDataFrame([(r,) for r in rows], "value string"), "value", "id int, x string")
    assert sorted((r.id, r["__op"], r["__deleted"], r["__phase"]) for r in got.collect()) == [
        (1, "c", False, "live"),
        (1, "d", True, "live"),
        (2, "r", False, "snapshot"),
    ]


def test_validity_intervals_of_equal_times(spark):
    df = spark.createDataFrame([(1, T0, 1), (1, T0, 2), (1, T0 + timedelta(days=1), 3)], "k int, ts timestamp_ntz, seq int")
    got = {r.seq: r.valid_to for r in C.validity_intervals(df, ["k"], "ts", ["seq"]).collect()}
    assert got == {1: T0, 2: T0 + timedelta(days=1), 3: None}


# -- quality ------------------------------------------------------------------


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(
        [("e1", None, "bogus", "5"), (None, "u", "ok", "x"), ("e3", "u", None, "500"), ("e4", "u", "ok", None)],
        "event_id string, user_id string, status string, amount string",
    )


def checks():
    return [
        *Q.not_null("event_id", "user_id"),
        *Q.accepted_values("status", ["ok"]),
        *Q.value_range("amount", 1, 100),
        *Q.accepted_types({"amount": "number", "status": "no such type"}),
    ]


def test_one_row_may_break_several_checks(messages):
    got = Q.violations(messages, "t", checks(), F.expr(AT))
    assert got.columns == ["test_name", "violation_type", "violation_details", "record", "detected_at"]
    assert sorted((r.violation_type, r.violation_details) for r in got.collect()) == [
        ("accepted_types:amount", "x"),
        ("accepted_values:status", "bogus"),
        ("not_null:event_id", None),
        ("not_null:user_id", None),
        ("range_max:amount", "500"),
    ]


def test_null_can_be_made_a_violation(messages):
    got = Q.check_results(messages, "t", Q.accepted_values("status", ["ok"], null_is_violation=True)).first()
    assert (got.checked, got.failures, got.passed) == (4, 2, False)


def test_one_scan_for_all_checks(messages):
    plan = Q.violations(messages, "t", checks(), F.expr(AT))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_empty_input_passes(messages):
    empty = messages.where("false")
    assert all(r.passed and r.checked == 0 for r in Q.check_results(empty, "t", checks()).collect())
    assert Q.unique_key_result(empty, "t", ["event_id"]).first().passed
    assert Q.foreign_key_result(empty, "t", "user_id", messages, "user_id").first().passed
    rate = Q.throughput_result(empty.withColumn("ts", F.expr(AT)), "t", "ts", "1 minute", 1, 2).first()
    assert rate.passed and rate.checked == 0


def test_good_and_bad_rows_partition_the_input(messages):
    good, bad = Q.split_on_checks(messages, checks(), metadata={"topic": F.lit("m")})
    assert [r.event_id for r in good.collect()] == ["e4"]
    assert {r.event_id: r.error for r in bad.collect()}["e1"] == "not_null:user_id;accepted_values:status"
    assert good.columns == messages.columns


def test_throughput_counts_empty_windows(spark):
    df = spark.createDataFrame([(T0,), (T0 + timedelta(minutes=1),), (T0 + timedelta(minutes=5),)], "ts timestamp_ntz")
    r = Q.throughput_result(df, "t", "ts", "1 minute", min_per_window=1).first()
    assert (r.checked, r.failures, r.observed) == (6, 3, 0.5)
    assert Q.throughput_result(df, "t", "ts", "1 minute", max_per_window=1).first().passed


def test_freshness_of_nothing_is_an_error(spark):
    df = spark.createDataFrame([(T0,)], "ts timestamp_ntz")
    assert Q.freshness(df, "ts", F.expr("timestamp_ntz'2024-01-01 00:01:00'"), 60, 120).first().status == "ok"
    assert Q.freshness(df, "ts", F.expr("timestamp_ntz'2024-01-01 00:01:01'"), 60, 120).first().status == "warn"
    assert Q.freshness(df.where("false"), "ts", F.expr(AT), 60, 120).first().status == "error"


def test_unknown_assertion_passes_with_a_warning(messages):
    r = Q.unknown_assertion(messages, "t", "odd").first()
    assert r.passed and r.assertion.startswith("warning")


def test_scalar_expectation(spark):
    q = spark.sql("select 3 as n")
    assert Q.scalar_result(q, "t", expect=3).first().passed
    assert not Q.scalar_result(q, "t", expect=4).first().passed
    assert not Q.scalar_result(spark.range(3).toDF("x"), "t", max_failures=2).first().passed


# -- masking ------------------------------------------------------------------


def test_partial_mask(spark):
    df = spark.createDataFrame([("020-7946-0018",), ("1234",), ("é9-ab12",), (None,)], "c string")
    got = [r[0] for r in df.select(M.partial(F.col("c"))).collect()]
    assert got == ["***-****-0018", "****", "**-ab12", None]


def test_masks_keep_null(spark):
    df = spark.createDataFrame([(None,)], "c string")
    row = df.select(M.redact(F.col("c")), M.hash_mask(F.col("c")), M.tokenize(F.col("c")), M.blank(F.col("c"), T.StringType())).first()
    assert list(row) == [None] * 4


def test_role_decides(spark):
    df = spark.createDataFrame([("secret", 5)], "c string, n int")
    policies = [M.MaskPolicy("c", "redact", ("guest",)), M.MaskPolicy("n", "null")]
    assert tuple(M.masked_view(df, policies, "guest").first()) == ("***", None)
    assert tuple(M.masked_view(df, policies, "admin").first()) == ("secret", None)
    assert M.masked_view(df, policies, "guest").schema["n"].dataType == T.IntegerType()


def test_column_names_that_contain_each_other(spark):
    """Only the named column is masked, not one whose name starts alike."""
    df = spark.createDataFrame([("a", "b")], "card string, card_brand string")
    assert tuple(M.masked_view(df, [M.MaskPolicy("card", "redact")]).first()) == ("***", "b")


def test_nothing_uncovered(spark):
    df = spark.createDataFrame([("a",)], "c string")
    assert M.uncovered_columns(df, {"c": "sensitive"}, [M.MaskPolicy("c", "hash")]).count() == 0


def test_evolution_modes(spark):
    df = spark.createDataFrame([(1, "7", None), (2, "x", "y")], "id int, a string, b string")
    target = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.IntegerType()), T.StructField("c", T.StringType(), False)])

    def verdicts(mode):
        return {r.column: (r.change, r.affected_rows, r.compatible) for r in M.evolution_check(df, target, mode).collect()}

    assert verdicts("FULL") == {
        "id": ("retyped", 0, True),
        "a": ("retyped", 1, False),
        "b": ("removed", 1, False),
        "c": ("added", 2, False),
    }
    assert verdicts("BACKWARD")["b"][2] and verdicts("FORWARD")["c"][2]


# -- routing, sources and sinks -----------------------------------------------


def test_first_reason_wins(spark):
    df = spark.createDataFrame([(1, None), (-1, "x"), (-1, None), (1, "x")], "n int, s string")
    got = R.with_error_reason(df, {"negative": F.col("n") < 0, "missing": F.col("s").isNull()})
    assert [r.error_reason for r in got.collect()] == ["missing", "negative", "negative", None]


def test_split_loses_no_row_when_a_condition_is_null(spark):
    df = spark.createDataFrame([(None,), (1,), (-1,)], "n int")
    valid, dead = R.split_valid(df, {"negative": F.col("n") < 0})
    assert valid.count() == 2 and dead.count() == 1


def test_routes_are_stable_and_near_the_share(spark):
    df = spark.range(5000).select((F.col("id") % 1000).alias("k"))
    routed = R.route_percentage(df, "k", F.lit(30))
    assert routed.groupBy("k").agg(F.count_distinct("route").alias("n")).where("n > 1").count() == 0
    share = routed.where("route = 'canary'").count() / 5000
    assert 0.2 < share < 0.4


def test_json_records(spark):
    rows = ['{"a": 1, "b": "x", "t": "2024-01-01 10:00:00"}', '{"a": "no", "b": 5}', "broken", None]
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    got = records.parse_json_records(df, "a int, b string, t timestamp", event_time="t")
    assert [tuple(r) for r in got.collect()] == [(1, "x", datetime(2024, 1, 1, 10)), (None, "5", None), (None, None, None), (None, None, None)]
    assert records.parse_json_records(df).columns == ["_raw"]


def test_unknown_payload_and_connector_are_refused(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        records.decode_payload(df, "xml", "a int")
    with pytest.raises(ValueError):
        sinks.write_connector(df, "ftp-sink", {})


def test_merge_statement():
    text = sinks.merge_statement("t", "t_new", ["id"], [], ["id", "v"])
    assert text == "MERGE INTO t t USING t_new s ON t.id = s.id WHEN MATCHED THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.v)"
    assert "WHEN MATCHED AND ((s.a > t.a) OR (s.a = t.a AND s.b >= t.b)) THEN" in sinks.merge_statement("t", "n", ["id"], ["a", "b"], ["id", "a", "b"])


class _Connection:
    """A DB-API connection on an in-process engine, which can be told to fail."""

    def __init__(self, engine, fail_on=None):
        self.engine, self.fail_on, self.open = engine, fail_on, False

    def cursor(self):
        return self

    def execute(self, text):
        if self.fail_on and text.startswith(self.fail_on):
            raise RuntimeError("lost")
        self.open = self.open or text == "BEGIN"
        self.engine.execute(text)

    def fetchone(self):
        return self.engine.fetchone()

    def commit(self):
        if self.open:
            self.engine.execute("COMMIT")
        self.open = False

    def rollback(self):
        if self.open:
            self.engine.execute("ROLLBACK")
        self.open = False

    def close(self):
        pass


def test_upsert_batches_end_in_the_target_once(spark):
    engine = duckdb.connect()
    engine.execute("CREATE TABLE orders (id BIGINT, v VARCHAR, seq BIGINT)")

    def stage(batch, table):
        engine.execute(f"CREATE OR REPLACE TABLE {table} (id BIGINT, v VARCHAR, seq BIGINT)")
        engine.executemany(f"INSERT INTO {table} VALUES (?, ?, ?)", [tuple(r) for r in batch.collect()])

    def writer(fail_on=None, stream="s"):
        return sinks.upsert_batches(lambda: _Connection(engine, fail_on), stage, "orders", ["id"], ["seq"], stream)

    batch = lambda *r: spark.createDataFrame(list(r), "id long, v string, seq long")
    now = lambda: engine.execute("SELECT id, v, seq FROM orders ORDER BY id").fetchall()
    writer()(batch((1, "a", 1), (1, "b", 2), (2, "c", 1)), 0)
    assert now() == [(1, "b", 2), (2, "c", 1)]
    second = batch((1, "old", 1), (2, "d", 3), (3, None, 1))
    for fail_on in ("MERGE", "INSERT INTO orders_ledger"):
        with pytest.raises(RuntimeError):
            writer(fail_on)(second, 1)
        assert now() == [(1, "b", 2), (2, "c", 1)]
        assert engine.execute("SELECT count(*) FROM orders_ledger").fetchone() == (1,)
    writer()(second, 1)
    writer()(batch((1, "again", 9)), 1)  # a repeated batch changes nothing
    assert now() == [(1, "b", 2), (2, "d", 3), (3, None, 1)]
    writer(stream="other")(batch((3, "z", 5)), 1)
    assert now()[2] == (3, "z", 5)
    assert engine.execute("SELECT stream, batch_id FROM orders_ledger ORDER BY 1, 2").fetchall() == [("other", 1), ("s", 0), ("s", 1)]
    assert engine.execute("SELECT count(*) FROM information_schema.tables WHERE table_name LIKE '%staging%'").fetchone() == (0,)


def test_upsert_names_are_plain():
    for names in (("a; drop", "s"), ("t", "it's")):
        with pytest.raises(ValueError):
            sinks.upsert_batches(None, None, names[0], ["id"], [], names[1])


def test_a_long_list_is_not_crossed(spark):
    assert J.cross_with_list(spark.range(3).toDF("a"), spark.range(2).toDF("b")).count() == 6
    with pytest.raises(ValueError):
        J.cross_with_list(spark.range(3).toDF("a"), spark.range(20).toDF("b"), most=10)


def test_kafka_options():
    assert records.kafka_options("h:1", "t")["startingOffsets"] == "earliest"
    assert records.kafka_options("h:1", "t", latest=True)["startingOffsets"] == "latest"


def test_time_folders_prune(spark, tmp_path):
    df = spark.createDataFrame([(T0 + timedelta(hours=h), h) for h in range(30)], "ts timestamp_ntz, v int")
    path = str(tmp_path / "out")
    sinks.write_time_partitioned(df, "ts", path)
    back = spark.read.parquet(path).where("day = 2")
    assert sorted(r.v for r in back.collect()) == list(range(24, 30))
    assert "PartitionFilters: [isnotnull(day" in back._jdf.queryExecution().executedPlan().toString()


def test_view_filter_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    sinks.virtual_view(orders, "v_orders", "o_totalprice > 100000")
    plan = spark.sql("select o_orderkey from v_orders where o_orderstatus = 'O'")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,100000.0), EqualTo(o" in plan
    assert "o_custkey" not in plan


def test_rate_stream_has_typed_columns(spark):
    s = records.rate_stream(spark, 5, ["a", "b"])
    assert s.isStreaming and {"amount", "quantity", "id", "kind"} <= set(s.columns)


def test_sample_is_ordered_and_skips_empty_payloads(spark):
    df = spark.createDataFrame([(3, "c"), (1, None), (2, "b"), (4, "d")], "offset int, value string")
    assert [r.value for r in records.sample_records(df, ["offset"], 2, "value").collect()] == ["b", "c"]


def test_retries(spark):
    fresh = spark.createDataFrame([(1,)], "id int")
    retry = spark.createDataFrame([(2, None), (3, 2), (4, 3)], "id int, retry_count int")
    work, spent = R.merge_retries(fresh, retry, 3)
    assert sorted(map(tuple, work.collect())) == [(1, 0), (2, 1), (3, 3)]
    assert [r.id for r in spent.collect()] == [4]
