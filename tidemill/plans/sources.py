"""Source and sink queries. Messages are built from ``events``; files go to the shared folder."""

import uuid

import pandas as pd
from pyspark.sql import functions as F

from tidemill.plans.catalog import query
from tidemill.session import shared_dir
from tidemill.sources import records as R
from tidemill.sources import sinks as S
from tidemill.tables import Tables


def scratch(t: Tables, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(t.spark)}/tidemill/{name}-{uuid.uuid4().hex}"


def _topic(t: Tables):
    """Events as JSON messages with an offset; some fields are absent or mistyped."""
    amount = F.when(F.col("user_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    body = F.struct(
        "event_id",
        F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("user_id"),
        amount.alias("amount"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
    )
    text = F.when(F.col("event_type") == "error", F.lit("not json")).otherwise(F.to_json(body))
    return t.events.select(F.col("event_id").alias("offset"), text.cast("binary").alias("value"))


@query(
    """
    SELECT event_id AS "offset", CASE WHEN event_type <> 'error' THEN event_id END AS event_id, CASE WHEN event_type <> 'error' AND user_id % 7 <> 0 THEN user_id END AS user_id,
           CASE WHEN event_type <> 'error' AND user_id % 5 <> 0 THEN value END AS amount, CASE WHEN event_type <> 'error' THEN ts END AS ts, NULL::VARCHAR AS note
    FROM events"""
)
def scan_json_topic(t: Tables):
    """Declared columns from JSON payloads: absent and mistyped fields are null."""
    schema = "event_id bigint, user_id bigint, amount double, ts timestamp, note string"
    return R.parse_json_records(_topic(t), schema, event_time="ts", keep=("offset",))


@query(
    """
    SELECT CASE WHEN event_type <> 'error' THEN event_id::VARCHAR END AS event_id, CASE WHEN event_type <> 'error' AND user_id % 7 <> 0 THEN user_id::VARCHAR END AS user_id
    FROM events"""
)
def scan_topic_as_text(t: Tables):
    """The monitor's view: every column as text."""
    return R.text_columns(_topic(t), ["event_id", "user_id"])


@query("SELECT event_id AS \"offset\", event_type = 'error' AS junk FROM events")
def scan_raw_topic(t: Tables):
    """No declared columns: the payload as ``_raw``."""
    raw = R.parse_json_records(_topic(t), keep=("offset",))
    return raw.select("offset", (F.col("_raw") == "not json").alias("junk"))


@query("SELECT event_id, value FROM events WHERE event_type <> 'error' ORDER BY ts, event_id LIMIT 100")
def bounded_sample(t: Tables):
    """The first 100 messages with a payload."""
    kept = t.events.withColumn("payload", F.when(F.col("event_type") != "error", F.col("props")))
    return R.sample_records(kept, ["ts", "event_id"], 100, "payload").select("event_id", "value")


@query("SELECT user_id::VARCHAR AS key, '{\"event_id\":' || event_id || ',\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}' AS value FROM events")
def rows_to_messages(t: Tables):
    """The append sink's payload: the row as JSON, keyed."""
    return S.to_messages(t.events.select("event_id", "user_id", "event_type"), "user_id")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def append_sink_round_trip(t: Tables):
    """Written as JSON files and read back by the declared schema."""
    path = scratch(t, "append")
    t.events.select("event_id", "event_type", "value").write.json(path)
    back = t.spark.read.schema("event_id bigint, event_type string, value double").json(path)
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    """
    SELECT 'large' AS output, count(*) AS n FROM events WHERE value > 50
    UNION ALL SELECT 'by_user', count(DISTINCT user_id) FROM events UNION ALL SELECT 'errors', count(*) FROM events WHERE event_type = 'error'"""
)
def fan_out_to_sinks(t: Tables):
    """One upstream batch, three models, three sinks."""
    path = scratch(t, "fan-out")
    outputs = {
        "large": lambda b: b.where(F.col("value") > 50),
        "by_user": lambda b: b.groupBy("user_id").agg(F.count("*").alias("n")),
        "errors": lambda b: b.where(F.col("event_type") == "error"),
    }
    run = S.fan_out(outputs, lambda df, name, batch: df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}"))
    run(t.events, 0)
    counts = [
        t.spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("output"), "n")
        for name in outputs
    ]
    return S.union_sources(*counts)


@query("SELECT year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, day(ts)::INTEGER AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def time_partitioned_sink(t: Tables):
    """Parquet in year/month/day/hour folders; the folder levels come back as columns."""
    path = scratch(t, "folders")
    S.write_time_partitioned(t.events, "ts", path)
    back = t.spark.read.parquet(path)
    return back.groupBy("year", "month", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    """
    SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1"""
)
def upsert_by_primary_key(t: Tables):
    """The state an upsert sink ends in: what was there, then the changes, newest row per key."""
    cols = ["o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"]
    before = t.orders.where(F.col("o_orderdate") < F.expr("timestamp_ntz'1998-01-01'")).select(*cols)
    changes = t.orders.where(F.col("o_orderdate") >= F.expr("timestamp_ntz'1998-01-01'")).select(*cols)
    return S.upsert(before, changes, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_totalprice")


@query(
    """
    SELECT 'c' || c_custkey AS party, c_acctbal AS balance, c_mktsegment AS segment, NULL::INTEGER AS nation FROM customer
    UNION ALL SELECT 's' || s_suppkey, s_acctbal, NULL, s_nationkey FROM supplier"""
)
def sink_from_several_topics(t: Tables):
    """Upstreams with different columns in one sink."""
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("party"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("party"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return S.union_sources(c, s)


@query("SELECT p_partkey, p_name FROM part")
def alias_view(t: Tables):
    """A virtual name over the physical table."""
    S.virtual_view(t.part, "catalogue_v2")
    return t.spark.sql("SELECT p_partkey, p_name FROM catalogue_v2")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 AND o_orderpriority = '1-URGENT'")
def filtered_view(t: Tables):
    """Filtered on read; the reader's own filter joins it in the scan."""
    S.virtual_view(t.orders, "open_large_orders", "o_orderstatus = 'O' AND o_totalprice > 100000")
    return t.spark.sql("SELECT o_orderkey, o_totalprice FROM open_large_orders WHERE o_orderpriority = '1-URGENT'")


@query("SELECT 12 AS partitions, true AS keys_together, count(*) AS n FROM events")
def output_partitions_by_key(t: Tables):
    """Twelve output partitions; rows of one key never split."""
    out = S.partitioned(t.events.select("user_id"), 12, "user_id").select("user_id", F.spark_partition_id().alias("p"))

    def report(batches):  # one row per partition, be it empty
        yield pd.DataFrame({"rows": [sum(len(b) for b in batches)]})

    partitions = out.mapInPandas(report, "rows long").agg(F.count("*")).scalar()
    per_key = out.groupBy("user_id").agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count("*").alias("n"))
    return per_key.agg(partitions.cast("int").alias("partitions"), F.bool_and(F.col("a") == F.col("b")).alias("keys_together"), F.sum("n").alias("n"))


@query("SELECT count(*) AS n, true AS amounts_ok, true AS quantities_ok, 3::BIGINT AS kinds FROM events")
def generated_columns(t: Tables):
    """RAND, RAND_INTEGER, UUID and an array pick beside every row."""
    g = R.generate_rows(t.events.select("event_id"), ["a", "b", "c"], 5)
    return g.agg(
        F.count_distinct("id").alias("n"),
        F.bool_and((F.col("amount") >= 0) & (F.col("amount") < 1)).alias("amounts_ok"),
        F.bool_and(F.col("quantity").between(0, 99)).alias("quantities_ok"),
        F.count_distinct("kind").alias("kinds"),
    )
