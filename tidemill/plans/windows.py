"""Time-window queries over ``events`` and ``orders``."""

from pyspark.sql import functions as F

from tidemill.operators import windows as W
from tidemill.plans.catalog import query
from tidemill.tables import Tables

VALID = "event_id IS NOT NULL AND value > 0"


def hourly_metrics(events):
    """Valid events per hour and type; the streaming query uses the same function."""
    out = W.tumble_agg(
        events.where(VALID), "ts", "1 hour", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")
    )
    return out.withColumn("mean", F.col("total") / F.col("n"))


@query(
    """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
           event_type, count(*) AS n, round(sum(value), 2) AS total, round(sum(value), 2) / count(*) AS mean
    FROM events WHERE event_id IS NOT NULL AND value > 0 GROUP BY ALL"""
)
def tumble_hourly_metrics(t: Tables):
    """Tumbling windows, group-window form."""
    return hourly_metrics(t.events)


@query(
    """
    SELECT event_id, window_start, window_start + INTERVAL 1 DAY AS window_end,
           window_start + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS window_time, value
    FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS window_start FROM events)"""
)
def tumble_row_form(t: Tables):
    """Tumbling windows, table-function form: every row with its window bounds and window time."""
    return W.tumble(t.events, "ts", "1 day").select("event_id", "window_start", "window_end", "window_time", "value")


@query(
    """
    SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 2) AS total
    FROM (SELECT *, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i) for i in range(4)]) AS window_start FROM events)
    GROUP BY ALL"""
)
def hop_window_totals(t: Tables):
    """Hopping windows of 1 hour every 15 minutes, by plain expansion."""
    return W.hop_agg(
        t.events, "ts", "1 hour", "15 minutes", ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    """
    SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_id
    FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * i) for i in range(4)]) AS window_start FROM events)"""
)
def hop_row_form(t: Tables):
    """Hopping windows, table-function form: each row once per window holding it."""
    return W.hop(t.events, "ts", "1 day", "6 hours").select("window_start", "window_end", "event_id")


@query(
    """
    SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, user_id, count(*) AS n,
           round(sum(value), 2) AS total, max(value) AS top, min(ts) AS first_seen
    FROM (SELECT *, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i) for i in range(24)]) AS window_start FROM events)
    GROUP BY ALL"""
)
def hop_from_panes(t: Tables):
    """Hopping windows with 24 slides per window, rolled up from panes of one slide."""
    out = W.hop_panes(
        t.events,
        "ts",
        "6 hours",
        "15 minutes",
        ["user_id"],
        {
            "n": (F.count("*"), F.sum),
            "total": (F.sum("value"), F.sum),
            "top": (F.max("value"), F.max),
            "first_seen": (F.min("ts"), F.min),
        },
    )
    return out.withColumn("total", F.round("total", 2))


@query(
    """
    SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, event_type, count(DISTINCT user_id) AS users
    FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts) - to_hours(i) for i in range(2)]) AS window_start FROM events)
    GROUP BY ALL"""
)
def hop_distinct_users(t: Tables):
    """Exact distinct counts in hopping windows, from the gaps between a value's panes."""
    return W.hop_distinct(t.events, "ts", "2 hours", "1 hour", ["event_type"], "user_id", "users")


@query(
    """
    SELECT 'tumble' AS kind, count(DISTINCT time_bucket(INTERVAL 1 DAY, ts)) AS n, true AS later, 1::BIGINT AS times FROM events
    UNION ALL SELECT 'hop', count(DISTINCT s), true, 1 FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts) - to_hours(12 * i) for i in range(2)]) AS s FROM events)
    UNION ALL SELECT 'session', sum(opens)::BIGINT, true, 1 FROM (SELECT CASE WHEN ts <= lag(ts) OVER (ORDER BY ts) + INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS opens FROM events)"""
)
def window_processing_time(t: Tables):
    """Processing time of tumbling, hopping and session windows: one time for a result, behind every window's end."""
    n = F.count("*").alias("rows")
    forms = {
        "tumble": W.tumble_agg(t.events, "ts", "1 day", [], n),
        "hop": W.hop_agg(t.events, "ts", "1 day", "12 hours", [], n),
        "session": W.session_panes(t.events, "ts", "20 minutes", [], {"rows": (F.count("*"), F.sum)}),
    }
    out = None
    for kind, windows in forms.items():
        times = W.with_proctime(windows).agg(
            F.lit(kind).alias("kind"),
            F.count("*").alias("n"),
            F.bool_and(F.col("window_proctime") > F.col("window_end").cast("timestamp")).alias("later"),
            F.count_distinct("window_proctime").alias("times"),
        )
        out = times if out is None else out.unionByName(times)
    return out


SESSIONS = """
    SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, count(*) AS n,
           round(sum(value), 2) AS total {more}
    FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
          FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens
                FROM events))
    GROUP BY user_id, s"""


@query(SESSIONS.format(more=", count(DISTINCT event_type) AS kinds"))
def session_windows(t: Tables):
    """Session windows of users with a gap of 2 hours, with an aggregate that does not merge."""
    return W.session(t.events, "ts", "2 hours", ["user_id"]).groupBy("user_id", "window_start", "window_end").agg(
        F.count("*").alias("n"),
        F.round(F.sum("value"), 2).alias("total"),
        F.count_distinct("event_type").alias("kinds"),
    )


@query(SESSIONS.format(more=", max(value) AS top"))
def session_from_panes(t: Tables):
    """The same sessions built from panes, for keys too hot to sort in one task."""
    out = W.session_panes(
        t.events,
        "ts",
        "2 hours",
        ["user_id"],
        {"n": (F.count("*"), F.sum), "total": (F.sum("value"), F.sum), "top": (F.max("value"), F.max)},
    )
    return out.withColumn("total", F.round("total", 2))


CUMULATE = """
    WITH e AS (
      SELECT {keys}, {values}, time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 3 HOUR, ts) + INTERVAL 3 HOUR AS pane_end
      FROM events)
    SELECT {keys}, window_start, window_end, {aggs}
    FROM (SELECT *, unnest([window_start + to_hours(3 * i) for i in range(1, 9)]) AS window_end FROM e)
    WHERE window_end >= pane_end GROUP BY ALL"""


@query(CUMULATE.format(keys="event_type", values="value", aggs="count(*) AS n, round(sum(value), 2) AS total, max(value) AS top"))
def cumulate_from_panes(t: Tables):
    """Cumulating windows: every 3 hours, the day so far."""
    out = W.cumulate_panes(
        t.events,
        "ts",
        "3 hours",
        "1 day",
        ["event_type"],
        {"n": (F.count("*"), F.sum), "total": (F.sum("value"), F.sum), "top": (F.max("value"), F.max)},
    )
    return out.withColumn("total", F.round("total", 2))


@query(CUMULATE.format(keys="event_type", values="user_id", aggs="count(DISTINCT user_id) AS users"))
def cumulate_distinct_users(t: Tables):
    """Exact distinct counts in cumulating windows, by expansion to the window ends."""
    return (
        W.cumulate(t.events, "ts", "3 hours", "1 day")
        .groupBy("event_type", "window_start", "window_end")
        .agg(F.count_distinct("user_id").alias("users"))
    )


@query(
    """
    WITH h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL)
    SELECT time_bucket(INTERVAL 1 DAY, s) AS window_start, time_bucket(INTERVAL 1 DAY, s) + INTERVAL 1 DAY AS window_end,
           event_type, sum(n)::BIGINT AS n, round(sum(total), 2) AS total, max(n) AS busiest_hour
    FROM h GROUP BY ALL"""
)
def cascade_hour_to_day(t: Tables):
    """A daily window over hourly windows, placed by window time (inside the hour)."""
    hours = (
        t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .withColumn("at", F.window_time("w"))
    )
    return W.tumble_agg(
        hours,
        "at",
        "1 day",
        ["event_type"],
        F.sum("n").alias("n"),
        F.round(F.sum("total"), 2).alias("total"),
        F.max("n").alias("busiest_hour"),
    )


@query(
    """
    WITH m AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS e, count(*) AS n FROM events GROUP BY ALL)
    SELECT time_bucket(INTERVAL 1 HOUR, e) AS window_start, time_bucket(INTERVAL 1 HOUR, e) + INTERVAL 1 HOUR AS window_end,
           sum(n)::BIGINT AS n, count(*) AS panes
    FROM m GROUP BY ALL"""
)
def cascade_by_window_end(t: Tables):
    """A window over ``window_end``: the last pane of an hour counts in the next one."""
    panes = W.tumble_agg(t.events, "ts", "15 minutes", [], F.count("*").alias("n")).select(F.col("window_end").alias("at"), "n")
    return W.tumble_agg(panes, "at", "1 hour", [], F.sum("n").alias("n"), F.count("*").alias("panes"))


@query(
    """
    WITH a AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY ALL),
         b AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, s) AS s, sum(n) AS n, round(sum(v), 2) AS v FROM a GROUP BY ALL)
    SELECT event_type, time_bucket(INTERVAL 1 DAY, s) AS window_start, sum(n)::BIGINT AS n, round(sum(v), 2) AS total, count(*) AS parts
    FROM b GROUP BY ALL"""
)
def cascade_three_levels(t: Tables):
    """1 hour, 6 hours and 1 day, each level reading the one below."""
    level = t.events.select("event_type", F.col("ts").alias("at"), F.lit(1).cast("long").alias("n"), F.col("value").alias("v"))
    for size in ("1 hour", "6 hours"):
        level = W.tumble_agg(
            level, "at", size, ["event_type"], F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("v")
        ).select("event_type", F.col("window_start").alias("at"), "n", "v")
    out = W.tumble_agg(
        level, "at", "1 day", ["event_type"], F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("total"), F.count("*").alias("parts")
    )
    return out.drop("window_end")


@query(
    """
    SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
           arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close
    FROM events GROUP BY ALL"""
)
def window_open_high_low_close(t: Tables):
    """First and last value by time as aggregates in a window."""
    order = F.struct("ts", "event_id")
    return W.tumble_agg(
        t.events,
        "ts",
        "1 day",
        ["user_id"],
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
    )
