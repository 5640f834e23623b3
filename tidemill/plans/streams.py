"""Streaming queries over file streams of the tables, run until the input known now is used up."""

from pyspark.sql import functions as F

from tidemill.operators import windows as W
from tidemill.operators import patterns as P
from tidemill.operators.automaton import Ref, Test
from tidemill.plans.catalog import query
from tidemill.plans.patterns import LETTERS
from tidemill.plans.quality import VIOLATIONS, _messages, violations_of
from tidemill.plans.sources import scratch
from tidemill.plans.windows import hourly_metrics
from tidemill.sources import records as R
from tidemill.sources import sinks as S
from tidemill.streaming import event_time as E
from tidemill.streaming import in_order
from tidemill.streaming import run
from tidemill.streaming import stateful
from tidemill.streaming.late import split_to
from tidemill.streaming.patterns import stream_match_rows
from tidemill.tables import Tables


def _ntz(df, *columns):
    """Zoned times back to the stored form."""
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


HELD_BYTES = 8 << 20  # of files a state partition, where rows wait in state and pass through Python


def _sized(t: Tables, bytes_each: int = 64 << 20):
    """State partitions for a stream over ``events``."""
    return run.settings(t.spark, **run.state_settings("rocksdb", run.state_partitions(t.events, bytes_each)))


def _append(t: Tables, df, name: str, bytes_each: int = 64 << 20):
    with _sized(t, bytes_each):
        return run.append_to(df, scratch(t, name))


def _update(t: Tables, df, name: str, keys: list[str]):
    with _sized(t):
        return run.update_to(df, scratch(t, name), keys)


CLOSED = "window_end <= (SELECT max(ts) FROM events) - INTERVAL {delay} MILLISECOND"


@query(
    f"""
    SELECT * FROM (
      SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
             event_type, count(*) AS n, round(sum(value), 2) AS total, round(sum(value), 2) / count(*) AS mean
      FROM events WHERE event_id IS NOT NULL AND value > 0 GROUP BY ALL) WHERE {CLOSED.format(delay=5000)}"""
)
def stream_tumble_on_close(t: Tables):
    """Append mode with a watermark of 5 s: each window once, when the watermark passes its end."""
    events = E.bounded_out_of_orderness(t.stream("events"), "ts")
    out = _append(t, hourly_metrics(events), "tumble")
    return _ntz(out, "window_start", "window_end")


@query(
    f"""
    SELECT * FROM (
      SELECT window_start, window_start + INTERVAL 2 DAY AS window_end, count(*) AS n
      FROM (SELECT unnest([time_bucket(INTERVAL 1 DAY, ts) - to_days(i) for i in range(2)]) AS window_start FROM events) GROUP BY ALL)
    WHERE {CLOSED.format(delay=0)}"""
)
def stream_hop_monotonic(t: Tables):
    """Hopping windows under a monotonously increasing watermark."""
    events = E.monotonously_increasing(t.stream("events"), "ts")
    hops = W.hop_agg(events, "ts", "2 days", "1 day", [], F.count("*").alias("n"))
    return _ntz(_append(t, hops, "hop"), "window_start", "window_end")


@query(
    """
    SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, user_id, count(*) AS n
    FROM events GROUP BY ALL"""
)
def stream_tumble_with_lateness(t: Tables):
    """Update mode with allowed lateness: windows are reported early and again on change."""
    events = E.bounded_out_of_orderness(t.stream("events"), "ts", 5000, lateness_ms=3_600_000)
    out = W.tumble_agg(events, "ts", "1 day", ["user_id"], F.count("*").alias("n"))
    return _ntz(_update(t, out, "late", ["window_start", "user_id"]), "window_start", "window_end")


SESSIONS = f"""
    SELECT * FROM (
      SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, count(*) AS n
      FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
            FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events))
      GROUP BY user_id, s) WHERE {CLOSED.format(delay=5000)}"""


@query(SESSIONS)
def stream_sessions(t: Tables):
    events = E.bounded_out_of_orderness(t.stream("events"), "ts")
    out = W.session_agg(events, "ts", "2 hours", ["user_id"], F.count("*").alias("n"))
    return _ntz(_append(t, out, "session"), "window_start", "window_end")


@query(
    f"""
    WITH h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT * FROM (SELECT time_bucket(INTERVAL 1 DAY, s) AS window_start, time_bucket(INTERVAL 1 DAY, s) + INTERVAL 1 DAY AS window_end, event_type, sum(n)::BIGINT AS n, max(n) AS busiest FROM h GROUP BY ALL)
    WHERE {CLOSED.format(delay=5000)}"""
)
def stream_cascade(t: Tables):
    """Hourly windows feeding daily ones in a single query."""
    events = E.bounded_out_of_orderness(t.stream("events"), "ts")
    hours = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    days = hours.groupBy(F.window(F.window_time("w"), "1 day").alias("d"), "event_type").agg(
        F.sum("n").alias("n"), F.max("n").alias("busiest")
    )
    out = days.select(F.col("d.start").alias("window_start"), F.col("d.end").alias("window_end"), "event_type", "n", "busiest")
    return _ntz(_append(t, out, "cascade"), "window_start", "window_end")


@query("SELECT user_id, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY ALL")
def stream_unbounded_groups(t: Tables):
    """GROUP BY without a window, continuously updated."""
    out = t.stream("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return _update(t, out, "groups", ["user_id", "event_type"])


@query("SELECT event_id, user_id FROM events")
def stream_deduplicate(t: Tables):
    """Every event sent twice, kept once."""
    events = t.stream("events").select("event_id", "user_id", "ts")
    once = E.deduplicate(events.union(events), ["event_id"], "ts", 3_600_000)
    return _append(t, once.select("event_id", "user_id"), "dedup")


@query(
    """
    SELECT p.event_id AS p_event_id, v.event_id AS v_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 3 HOUR AND p.ts + INTERVAL 90 MINUTE"""
)
def stream_interval_join(t: Tables):
    """Two streams joined on key and time; state is dropped once no partner can come."""

    def side(kind, p):
        e = E.bounded_out_of_orderness(t.stream("events"), "ts").where(F.col("event_type") == kind)
        return e.select(*[F.col(c).alias(f"{p}_{c}") for c in ("event_id", "user_id", "ts")])

    p, v = side("purchase", "p"), side("view", "v")
    near = F.expr("v_ts BETWEEN p_ts - interval 3 hours AND p_ts + interval 90 minutes")
    joined = p.join(v, (F.col("p_user_id") == F.col("v_user_id")) & near)
    return _append(t, joined.select("p_event_id", "v_event_id"), "interval")


@query(
    """
    SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey"""
)
def stream_lookup_join(t: Tables):
    """A stream against a table that is read again for every micro-batch."""
    joined = t.stream("events").join(t.customer, F.col("user_id") == F.col("c_custkey"), "left")
    return _append(t, joined.select("event_id", "c_mktsegment"), "lookup")


@query(VIOLATIONS)
def stream_violations(t: Tables):
    """The continuous monitor: the assertions of the batch test on a stream."""
    at = F.expr("timestamp_ntz'2024-02-01 00:00:00'")

    class Streamed:
        events = t.stream("events")

    return _append(t, violations_of(_messages(Streamed), at), "violations")


@query("SELECT event_id, user_id, value FROM events WHERE value > 10")
def stream_json_scan_and_sink(t: Tables):
    """Messages read as a stream from JSON text, filtered, and appended as JSON text again."""
    path = scratch(t, "json")
    S.to_messages(t.events.select("event_id", "user_id", "value")).write.text(f"{path}/topic")
    topic = t.spark.readStream.text(f"{path}/topic")
    rows = R.parse_json_records(topic, "event_id bigint, user_id bigint, value double")
    S.append(S.to_messages(rows.where(F.col("value") > 10)), "text", f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return R.parse_json_records(t.spark.read.text(f"{path}/out"), "event_id bigint, user_id bigint, value double")


@query(
    """
    SELECT 'errors' AS output, count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT 'large', count(*) FROM events WHERE value > 50"""
)
def stream_fan_out(t: Tables):
    """One stream, two sinks, the batch read once."""
    path = scratch(t, "stream-fan-out")
    models = {"errors": lambda b: b.where(F.col("event_type") == "error"), "large": lambda b: b.where(F.col("value") > 50)}
    write = S.fan_out(models, lambda df, name, n: df.write.mode("overwrite").parquet(f"{path}/{name}/batch={n}"))
    q = t.stream("events").writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/cp")
    q.trigger(availableNow=True).start().awaitTermination()
    counts = [
        t.spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("output"), "n") for name in models
    ]
    return S.union_sources(*counts)


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_state_with_ttl(t: Tables):
    """Per-user totals in state that expires a day after its last write."""
    conf = run.state_settings("rocksdb") | {"spark__sql__streaming__noDataMicroBatches__enabled": "false"}
    with run.settings(t.spark, **conf):
        totals = stateful.totals_with_ttl(t.stream("events"), ["user_id"], "value", 86_400_000)
        out = _update(t, totals, "ttl", ["user_id"])
    return out.withColumn("total", F.round("total", 2))


LATE = """
    WITH o AS (SELECT event_id, ts, user_id % 4 AS part, event_id * 7919 % 10007 AS off FROM events),
         w AS (SELECT *, max(ts) OVER (PARTITION BY part ORDER BY off, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 20 DAY AS wm FROM o)"""


def _shuffled(df):
    """Events in a scrambled but repeatable arrival order, on four source partitions."""
    off = (F.col("event_id") * 7919) % 10007 * 100_000_000 + F.col("event_id")
    return df.select("event_id", "ts", (F.col("user_id") % 4).alias("part"), off.alias("off"))


@query(LATE + "SELECT event_id, wm AS current_watermark FROM w")
def current_watermark(t: Tables):
    """Event-time progress of each source partition before every row (batch replay)."""
    out = E.with_current_watermark(_shuffled(t.events), "ts", ["part"], "off", 20 * 86_400_000)
    return out.select("event_id", "current_watermark")


@query(LATE + "SELECT event_id, coalesce(ts < wm, false) AS late FROM w")
def late_rows_to_side_output(t: Tables):
    """Rows behind the watermark are routed, not lost (batch replay)."""
    on_time, late = E.split_late(_shuffled(t.events), "ts", ["part"], "off", 20 * 86_400_000)
    return on_time.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


@query(LATE + "SELECT event_id, coalesce(ts < wm, false) AS late FROM w")
def stream_late_rows(t: Tables):
    """The same on a stream, with the progress of each source partition handed from batch to batch."""
    on_time, late = split_to(_shuffled(t.stream("events")), "part", "ts", "off", 20 * 86_400_000, scratch(t, "late"))
    return on_time.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


@query(
    """
    WITH s AS (SELECT user_id AS u, ts AS signed_at, arg_max(event_id, event_id) AS signup_id, arg_max(value, event_id) AS signup_value FROM events WHERE event_type = 'signup' GROUP BY ALL),
         p AS (SELECT * FROM events WHERE event_type = 'purchase')
    SELECT event_id, user_id, signup_id, signup_value FROM p ASOF LEFT JOIN s ON user_id = u AND ts >= signed_at
    WHERE epoch_ms(ts) + (ts > date_trunc('millisecond', ts))::INTEGER <= (SELECT epoch_ms(max(ts)) - 1000 FROM events WHERE event_type IN ('purchase', 'signup'))"""
)
def stream_as_of_join(t: Tables):
    """Purchases with the signup valid at their time, answered when the watermark passes them."""
    e = t.stream("events")
    probes = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    versions = e.where(F.col("event_type") == "signup").select(
        F.col("user_id").alias("u"), F.col("ts").alias("at"), F.col("event_id").alias("signup_id"), F.col("value").alias("signup_value")
    )
    with run.settings(t.spark, **run.state_settings("rocksdb")):
        joined = in_order.stream_as_of_join(
            probes, versions, ("user_id", "u"), "ts", "at", ["signup_id", "signup_value"], "signup_id", 1000
        )
        return _append(t, joined.drop("ts"), "as-of", HELD_BYTES)


@query(
    LETTERS.format(
        letter="CASE event_type WHEN 'view' THEN 'V' WHEN 'click' THEN 'C' WHEN 'purchase' THEN 'P' ELSE '.' END", regex="V+C+P"
    )
    + """SELECT user_id, times[start]::TIMESTAMP AS session_start, ids[start + length(hit) - 1] AS purchase_id, length(hit)::INTEGER AS rows FROM m
         WHERE epoch_ms(times[start + length(hit) - 1]::TIMESTAMP) + 1 <= (SELECT epoch_ms(max(ts)) - 1000 FROM events)"""
)
def stream_match_browse_to_purchase(t: Tables):
    """PATTERN (A+ B+ C) on a stream: a match leaves when the watermark has passed its purchase."""
    kind = F.col("event_type")
    events = t.stream("events").select("event_id", "user_id", "ts", "event_type")
    with run.settings(t.spark, **run.state_settings("rocksdb")):
        found = stream_match_rows(
            events,
            "user_id",
            "ts",
            "event_id",
            [("A", "+"), ("B", "+"), ("C", "")],
            {"A": kind == "view", "B": kind == "click", "C": kind == "purchase"},
            1000,
        )
        measures = found.select(
            "user_id",
            P.first_of("A", "ts").alias("session_start"),
            P.first_of("C", "event_id").alias("purchase_id"),
            P.count_of(None).alias("rows"),
        )
        return _append(t, measures, "match")


@query(
    """
    SELECT event_id, before, value - before AS change FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    WHERE epoch_ms(ts) + (ts > date_trunc('millisecond', ts))::INTEGER <= (SELECT epoch_ms(max(ts)) - 1000 FROM events)"""
)
def stream_lag(t: Tables):
    """LAG on a stream: every event with the user's value before it."""
    events = t.stream("events").select("event_id", "user_id", "ts", "value")
    with run.settings(t.spark, **run.state_settings("rocksdb")):
        lagged = in_order.stream_lag(events, "user_id", "ts", "event_id", 1000)
        before = F.col("previous.value")
        out = lagged.select("event_id", before.alias("before"), (F.col("value") - before).alias("change"))
        return _append(t, out, "lag", HELD_BYTES)


FINAL = "epoch_ms({0}) + ({0} > date_trunc('millisecond', {0}))::INTEGER <= (SELECT epoch_ms(max(ts)) - 1000 FROM events)"


@query(
    f"""
    WITH o AS (SELECT *, CASE WHEN value > lag(value) OVER w THEN 0 ELSE 1 END AS cut, lead(ts) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM o),
         g AS (SELECT user_id, arg_min(value, (ts, event_id)) AS start_value, arg_max(value, (ts, event_id)) AS end_value, min(ts) AS start_time, max(ts) AS end_time,
                 count(*) - 1 AS rises, arg_max_null(after, (ts, event_id)) AS decided FROM r GROUP BY user_id, run HAVING count(*) > 1)
    SELECT user_id, start_value, end_value, start_time, end_time, rises FROM g WHERE {FINAL.format("decided")}"""
)
def stream_match_rising_values(t: Tables):
    """PATTERN (A B+) with B AS value > LAST(value) on a stream: a run leaves with the row that ends it."""
    events = t.stream("events").select("event_id", "user_id", "ts", "value")
    with run.settings(t.spark, **run.state_settings("rocksdb")):
        found = in_order.stream_match(
            events,
            "user_id",
            "ts",
            "event_id",
            [("A", ""), ("B", "+")],
            {"B": Test(("value",), (Ref(None, "value"),), lambda value, before: value > before)},
            {
                "start_value": ("first", "A", "value"),
                "end_value": ("last", "B", "value"),
                "start_time": ("first", "A", "ts"),
                "end_time": ("last", "B", "ts"),
                "rises": ("count", "B", ""),
            },
            1000,
        )
        return _append(t, found, "rising", HELD_BYTES)


@query(
    f"""
    WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE value IS NOT NULL AND {FINAL.format("ts")}),
         c AS (SELECT a.user_id, a.p, a.ts, a.value, min(b.p) AS q FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.p > a.p AND b.value <= a.value - 10 GROUP BY ALL),
         m AS (SELECT c.*, b.value AS low, b.ts AS drop_time FROM c LEFT JOIN e b ON b.user_id = c.user_id AND b.p = c.q WHERE c.q IS NULL OR b.value < c.value - 10),
         w AS (SELECT user_id, min(p) AS p FROM m GROUP BY 1
               UNION ALL SELECT w.user_id, min(n.p) FROM w JOIN m ON m.user_id = w.user_id AND m.p = w.p JOIN m n ON n.user_id = w.user_id AND n.p > m.q GROUP BY w.user_id)
    SELECT user_id, m.ts AS start_time, drop_time, value AS high, low, q - p - 1 AS held FROM m SEMI JOIN w USING (user_id, p) WHERE q IS NOT NULL"""
)
def stream_match_price_drop(t: Tables):
    """PATTERN (A B* C) with conditions on A's row, on a stream; an undecided start holds back the matches behind it."""
    events = t.stream("events").select("event_id", "user_id", "ts", "value").where("value IS NOT NULL")
    a = Ref("A", "value")
    with run.settings(t.spark, **run.state_settings("rocksdb")):
        found = in_order.stream_match(
            events,
            "user_id",
            "ts",
            "event_id",
            [("A", ""), ("B", "*"), ("C", "")],
            {"B": Test(("value",), (a,), lambda value, a: value > a - 10), "C": Test(("value",), (a,), lambda value, a: value < a - 10)},
            {
                "start_time": ("first", "A", "ts"),
                "drop_time": ("first", "C", "ts"),
                "high": ("first", "A", "value"),
                "low": ("first", "C", "value"),
                "held": ("count", "B", ""),
            },
            1000,
        )
        return _append(t, found, "price-drop", HELD_BYTES)


@query(
    f"""
    SELECT * FROM (
      SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, event_type, count(DISTINCT user_id) AS users
      FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts) - to_hours(i) for i in range(2)]) AS window_start FROM events) GROUP BY ALL) WHERE {CLOSED.format(delay=5000)}"""
)
def stream_hop_distinct_users(t: Tables):
    """Exact distinct users in hopping windows on a stream."""
    out = _append(t, E.distinct_per_window(t.stream("events"), "ts", "2 hours", ["event_type"], "user_id", "users", slide="1 hour"), "distinct")
    return _ntz(out, "window_start", "window_end")


@query("SELECT 'earliest' AS start, count(*) AS n FROM events UNION ALL SELECT 'latest', 0")
def stream_scan_from_latest(t: Tables):
    """A stream from the start of its source, and one that skips what is there already."""
    every = _append(t, t.stream("events").select("event_id"), "earliest")
    new = _append(t, R.skip_backlog(t.stream("events"), "2999-01-01").select("event_id"), "latest")
    counts = [rows.agg(F.lit(start).alias("start"), F.count("*").alias("n")) for start, rows in (("earliest", every), ("latest", new))]
    return counts[0].unionByName(counts[1])
