"""OVER queries. ``Ordered`` keeps them safe for a hot partition key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.operators.cdc import earliest_per_key
from tidemill.operators.frames import range_frame, row_frame
from tidemill.operators.ordered import Ordered
from tidemill.plans.catalog import query
from tidemill.tables import Tables


@query(
    """
    SELECT event_id, event_type,
           row_number() OVER w AS row_number, rank() OVER p AS rank, dense_rank() OVER p AS dense_rank, ntile(4) OVER w AS ntile
    FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id), p AS (PARTITION BY event_type ORDER BY value)"""
)
def ranking_functions(t: Tables):
    events = t.events.select("event_id", "event_type", "value")
    out = Ordered(events, ["event_type"], "value", ["event_id"]).ranks(tiles=4)
    return out.select("event_id", "event_type", "row_number", "rank", "dense_rank", "ntile")


@query(
    """
    SELECT event_id, cume_dist() OVER w AS cume_dist, percent_rank() OVER w AS percent_rank
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value)"""
)
def distribution_functions(t: Tables):
    events = t.events.select("event_id", "event_type", "value")
    return Ordered(events, ["event_type"], "value").ranks().select("event_id", "cume_dist", "percent_rank")


@query(
    """
    SELECT event_id, lag(value) OVER w AS previous, lag(value, 2, 0.0) OVER w AS before_that, lead(ts) OVER w AS next_at,
           value - lag(value) OVER w AS change
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def lag_and_lead(t: Tables):
    events = t.events.select("event_id", "user_id", "ts", "value")
    out = Ordered(events, ["user_id"], "ts", ["event_id"]).over_rows(
        {
            "previous": lambda w: F.lag("value").over(w),
            "before_that": lambda w: F.lag("value", 2, 0.0).over(w),
            "next_at": lambda w: F.lead("ts").over(w),
        },
        before=2,
        after=1,
    )
    return out.select("event_id", "previous", "before_that", "next_at", (F.col("value") - F.col("previous")).alias("change"))


@query(
    """
    SELECT event_id, first_value(value) OVER w AS first_value, last_value(value) OVER w AS last_value, nth_value(value, 3) OVER w AS third_value
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def first_last_nth_value(t: Tables):
    """Default frames: from the first row of the key up to the current one."""
    line = Ordered(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", ["event_id"])
    out = line.ranks(nth={"first_value": ("value", 1), "third_value": ("value", 3)})
    return out.select("event_id", "first_value", F.col("value").alias("last_value"), "third_value")


@query(
    """
    SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS last_purchase,
           first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS first_purchase
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def carry_forward_ignoring_nulls(t: Tables):
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    line = Ordered(t.events.select("event_id", "user_id", "ts", "event_type", "value"), ["user_id"], "ts", ["event_id"])
    return line.running({"last_purchase": ("last", bought), "first_purchase": ("first", bought)}).select(
        "event_id", "last_purchase", "first_purchase"
    )


@query(
    """
    SELECT event_id, round(sum(value) OVER w, 2) AS running_total, count(*) OVER w AS running_count,
           min(value) OVER w AS running_min, max(value) OVER w AS running_max
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def running_aggregates(t: Tables):
    line = Ordered(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", ["event_id"])
    v = F.col("value")
    out = line.running(
        {"running_total": ("sum", v), "running_count": ("count", v), "running_min": ("min", v), "running_max": ("max", v)}
    )
    return out.select("event_id", F.round("running_total", 2).alias("running_total"), "running_count", "running_min", "running_max")


@query(
    """
    SELECT event_id, round(sum(value) OVER w, 2) / count(*) OVER w AS moving_avg, max(value) OVER w AS moving_max
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
)
def moving_aggregates(t: Tables):
    line = Ordered(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", ["event_id"])
    frame = lambda w: w.rowsBetween(-4, 0)
    out = line.over_rows(
        {
            "moving_avg": lambda w: F.round(F.sum("value").over(frame(w)), 2) / F.count("*").over(frame(w)),
            "moving_max": lambda w: F.max("value").over(frame(w)),
        },
        before=4,
    )
    return out.select("event_id", "moving_avg", "moving_max")


@query(
    """
    SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 2) AS day_total
    FROM events"""
)
def time_range_frame(t: Tables):
    """A frame of the last 24 hours, dealt by key and hour and a half."""
    events = t.events.select("event_id", "user_id", "ts", "value")
    out = range_frame(events, ["user_id"], "ts", "1 day", {"day_total": ("sum", F.col("value"))})
    return out.select("event_id", F.round("day_total", 2).alias("day_total"))


@query(
    """
    SELECT event_id, max(value) OVER w AS high, min(value) OVER w AS low, count(value) OVER w AS n, round(sum(value) OVER w, 2) AS total
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 500 PRECEDING AND CURRENT ROW)"""
)
def long_row_frame(t: Tables):
    """Frames of 501 rows over six keys, each dealt by position."""
    v = F.col("value")
    events = t.events.select("event_id", "event_type", "ts", "value")
    aggs = {"high": ("max", v), "low": ("min", v), "n": ("count", v), "total": ("sum", v)}
    out = row_frame(events, ["event_type"], "ts", 500, aggs, ties=["event_id"])
    return out.select("event_id", "high", "low", "n", F.round("total", 2).alias("total"))


@query("SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def deduplicate_keep_first(t: Tables):
    """ROW_NUMBER() … WHERE rn = 1 as an aggregate that combines before the shuffle."""
    return earliest_per_key(t.events.drop("props"), ["user_id", "event_type"], ["ts", "event_id"])


@query(
    """
    SELECT user_id, event_id, value, rn FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3"""
)
def top_three_per_user(t: Tables):
    """Each task keeps three rows per key before the shuffle (window group limit)."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    ranked = t.events.select("user_id", "event_id", "value", F.row_number().over(w).cast("long").alias("rn"))
    return ranked.where(F.col("rn") <= 3)


@query(
    """
    SELECT day, n, rank() OVER (ORDER BY n DESC) AS busiest, sum(n) OVER (ORDER BY day)::BIGINT AS so_far
    FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)"""
)
def global_order_over_aggregate(t: Tables):
    """A global ordering, over one row per day: the input of the window grows with days, not rows."""
    days = t.events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return days.select(
        "day",
        "n",
        F.rank().over(Window.orderBy(F.desc("n"))).cast("long").alias("busiest"),
        F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"),
    )


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position, round(sum(value) OVER (ORDER BY ts, event_id), 2) AS running_total FROM events")
def global_row_number(t: Tables):
    """ROW_NUMBER() and a running sum over the whole table: sliced like one heavy key."""
    events = t.events.select("event_id", "ts", "value")
    numbered = Ordered(events, [], "ts", ["event_id"]).running(
        {"position": ("count", F.lit(1)), "running_total": ("sum", F.col("value"))}
    )
    return numbered.select("event_id", "position", F.round("running_total", 2).alias("running_total"))
