"""Join queries."""

from pyspark.sql import functions as F

from tidemill.operators import joins as J
from tidemill.operators.cdc import latest_per_key
from tidemill.operators.sizes import settle
from tidemill.plans.catalog import query
from tidemill.tables import Tables


@query(
    """
    SELECT o_orderkey, l_linenumber, c_mktsegment, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    JOIN customer ON o_custkey = c_custkey WHERE l_shipdate > o_orderdate AND c_acctbal > 0"""
)
def inner_join(t: Tables):
    return (
        t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .where((F.col("l_shipdate") > F.col("o_orderdate")) & (F.col("c_acctbal") > 0))
        .select("o_orderkey", "l_linenumber", "c_mktsegment", "l_extendedprice")
    )


@query(
    """
    SELECT a.l_orderkey AS l_orderkey, a.l_linenumber AS l_linenumber, b.l_partkey AS l_partkey
    FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') a
    JOIN (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount > 0.05) b
      ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber"""
)
def multi_column_key_join(t: Tables):
    a = t.lineitem.where(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")
    b = t.lineitem.where(F.col("l_discount") > 0.05).select("l_orderkey", "l_linenumber", "l_partkey")
    return a.join(b, ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000")
def left_join(t: Tables):
    big = t.orders.where((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000))
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT user_id, c_custkey FROM (SELECT DISTINCT user_id + 100 AS user_id FROM events) RIGHT JOIN customer ON user_id = c_custkey")
def right_join(t: Tables):
    users = t.events.select((F.col("user_id") + 100).alias("user_id")).distinct()
    return users.join(t.customer, F.col("user_id") == F.col("c_custkey"), "right").select("user_id", "c_custkey")


@query(
    """
    SELECT coalesce(c_nationkey, s_nationkey) AS nation, customers, suppliers
    FROM (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_nationkey < 20 GROUP BY 1)
    FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_nationkey > 5 GROUP BY 1) ON c_nationkey = s_nationkey"""
)
def full_join(t: Tables):
    c = t.customer.where(F.col("c_nationkey") < 20).groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    s = t.supplier.where(F.col("s_nationkey") > 5).groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    return c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full").select(
        F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "customers", "suppliers"
    )


@query(
    """
    SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'"""
)
def dimension_joins(t: Tables):
    """A chain of left joins; the optimizer broadcasts what its size check allows."""
    region = t.region.where(F.col("r_name") != "ASIA")
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("o_orderkey", "c_name", "n_name", "r_name")
    )


@query(
    """
    SELECT o_orderkey, round(o_totalprice / top, 6) AS share, o_totalprice > mean AS above
    FROM orders CROSS JOIN (SELECT max(o_totalprice) AS top, round(sum(o_totalprice), 2) / count(*) AS mean FROM orders)"""
)
def cross_join_one_row(t: Tables):
    """CROSS JOIN with a one-row configuration table, as scalar subqueries."""
    config = t.orders.agg(
        F.max("o_totalprice").alias("top"), (F.round(F.sum("o_totalprice"), 2) / F.count("*")).alias("mean")
    )
    top, mean = config.select("top").scalar(), config.select("mean").scalar()
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.round(price / top, 6).alias("share"), (price > mean).alias("above"))


@query(
    """
    SELECT s_suppkey, r_regionkey, CASE WHEN n_regionkey = r_regionkey THEN 'home' ELSE 'abroad' END AS place
    FROM supplier JOIN nation ON s_nationkey = n_nationkey CROSS JOIN region"""
)
def cross_join_fixed_list(t: Tables):
    """Every supplier against the five regions, a list whose size is checked."""
    home = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    each = J.cross_with_list(home, t.region.select("r_regionkey"))
    place = F.when(F.col("n_regionkey") == F.col("r_regionkey"), "home").otherwise("abroad")
    return each.select("s_suppkey", "r_regionkey", place.alias("place"))


def _typed(t: Tables, kind: str, p: str):
    e = t.events.where(F.col("event_type") == kind)
    return e.select(*[F.col(c).alias(f"{p}_{c}") for c in ("event_id", "user_id", "ts", "value")])


INTERVAL = """
    SELECT p.event_id AS p_event_id, v.event_id AS v_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    {how} JOIN (SELECT * FROM events WHERE event_type = 'view') v
      ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 3 HOUR AND p.ts + INTERVAL 90 MINUTE"""


def _interval(t: Tables, how: str):
    joined = J.interval_join(
        _typed(t, "purchase", "p"),
        _typed(t, "view", "v"),
        {"p_user_id": "v_user_id"},
        "p_ts",
        "v_ts",
        "-3 hours",
        "90 minutes",
        how,
    )
    return joined.select("p_event_id", "v_event_id")


@query(INTERVAL.format(how="INNER"))
def interval_join_inner(t: Tables):
    return _interval(t, "inner")


@query(INTERVAL.format(how="LEFT"))
def interval_join_left(t: Tables):
    return _interval(t, "left")


@query(INTERVAL.format(how="FULL"))
def interval_join_full(t: Tables):
    return _interval(t, "full")


@query(
    """
    WITH v AS (SELECT o_custkey, o_orderdate, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS priority
               FROM orders GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, l_suppkey, status, priority
    FROM lineitem ASOF LEFT JOIN v ON l_suppkey = o_custkey AND l_shipdate >= o_orderdate"""
)
def as_of_join_left(t: Tables):
    """FOR SYSTEM_TIME AS OF: the account's state on the day a line was shipped."""
    versions = t.orders.select(
        "o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")
    )
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    return J.as_of_join(
        lines, versions, {"l_suppkey": "o_custkey"}, "l_shipdate", "o_orderdate", ["status", "priority"], ["o_orderkey"]
    ).drop("l_shipdate")


@query(
    """
    WITH v AS (SELECT o_custkey, o_orderdate, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) AS price
               FROM orders GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, price FROM lineitem ASOF JOIN v ON l_suppkey = o_custkey AND l_shipdate >= o_orderdate
    WHERE status <> 'F'"""
)
def as_of_join_with_deletes(t: Tables):
    """Inner as-of join; a version that is a delete (status F) ends the validity of the one before."""
    versions = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    return J.as_of_join(
        lines,
        versions,
        {"l_suppkey": "o_custkey"},
        "l_shipdate",
        "o_orderdate",
        ["price"],
        ["o_orderkey"],
        deleted=F.col("o_orderstatus") == "F",
        how="inner",
    ).select("l_orderkey", "l_linenumber", "price")


@query(
    """
    WITH s AS (SELECT user_id, ts, event_id AS signup_id FROM events WHERE event_type = 'signup'),
         w AS (SELECT user_id, ts, event_id AS view_id, value AS view_value FROM events WHERE event_type = 'view')
    SELECT p.event_id, signup_id, view_id, view_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts
    ASOF LEFT JOIN w ON p.user_id = w.user_id AND p.ts >= w.ts"""
)
def chained_as_of_joins(t: Tables):
    """Each purchase with the user's last signup and last view at that time."""

    def versions(kind, **names):
        e = t.events.where(F.col("event_type") == kind)
        return e.select(F.col("user_id").alias("_u"), F.col("ts").alias("_ts"), *[F.col(c).alias(n) for n, c in names.items()])

    bought = t.events.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    first = J.as_of_join(
        bought, versions("signup", signup_id="event_id"), {"user_id": "_u"}, "ts", "_ts", ["signup_id"], ["signup_id"]
    )
    both = J.as_of_join(
        settle(first),
        versions("view", view_id="event_id", view_value="value"),
        {"user_id": "_u"},
        "ts",
        "_ts",
        ["view_id", "view_value"],
        ["view_id"],
    )
    return both.select("event_id", "signup_id", "view_id", "view_value")


@query(
    """
    WITH d AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1)
    SELECT event_id, status FROM events LEFT JOIN d ON user_id = o_custkey"""
)
def lookup_join_current_row(t: Tables):
    """Lookup on processing time: the dimension's current row per key."""
    current = latest_per_key(
        t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"]
    )
    return t.events.join(current, F.col("user_id") == F.col("o_custkey"), "left").select(
        "event_id", F.col("o_orderstatus").alias("status")
    )


VALIDITY = """
    SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem
    LEFT JOIN (SELECT o_orderkey, o_custkey, o_orderdate AS s, o_orderdate + INTERVAL 90 DAY AS e FROM orders)
      ON l_suppkey = o_custkey AND l_shipdate >= s AND l_shipdate <= e"""


def _validity(t: Tables, grain="1 day"):
    ranges = t.orders.select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("interval 90 days")).alias("e")
    )
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    out = J.validity_join(lines, ranges, {"l_suppkey": "o_custkey"}, "l_shipdate", "s", "e", "left", grain)
    return out.select("l_orderkey", "l_linenumber", "o_orderkey")


@query(VALIDITY)
def validity_range_join(t: Tables):
    """A line with every offer of its account valid on the shipping day."""
    return _validity(t)


@query(VALIDITY)
def validity_range_join_bucketed(t: Tables):
    """The same over a tree of coarse pieces, where the exact times decide more."""
    return _validity(t, "60 days")


@query(
    """
    SELECT c_custkey, s_suppkey FROM customer JOIN (SELECT s_suppkey, substr(s_name, 9) AS entity FROM supplier) ON c_name LIKE '%' || entity || '%'"""
)
def text_containment_join(t: Tables):
    """Names found inside other names, through shared character runs instead of all pairs."""
    watch = t.supplier.select("s_suppkey", F.substr("s_name", F.lit(9)).alias("entity"))
    return J.contains_join(t.customer.select("c_custkey", "c_name"), watch, "c_name", "entity", gram=10).select(
        "c_custkey", "s_suppkey"
    )


@query(
    """
    SELECT c_custkey, coalesce(orders, 0) AS orders, coalesce(total, 0) AS total, last_order FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last_order FROM orders
               WHERE o_orderstatus <> 'P' GROUP BY 1) ON c_custkey = o_custkey"""
)
def join_then_aggregate(t: Tables):
    """The fact side is aggregated per key before the join."""
    o = t.orders.where(F.col("o_orderstatus") != "P").groupBy("o_custkey").agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("last_order")
    )
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("total", F.lit(0.0)).alias("total"), "last_order"
    )


@query(
    """
    SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000) AS big_spender FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
      AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')"""
)
def semi_anti_and_flag(t: Tables):
    key = F.col("c_custkey") == F.col("o_custkey")
    done = t.orders.where(F.col("o_orderstatus") == "F")
    low = t.orders.where(F.col("o_orderpriority") == "5-LOW")
    big = t.orders.where(F.col("o_totalprice") > 480000)
    kept = t.customer.join(done, key, "left_semi").join(low, key, "left_anti")
    return J.flag_members(kept, big, {"c_custkey": "o_custkey"}, "big_spender").select("c_custkey", "big_spender")


RECONCILE = """
    WITH l AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0),
         n AS (SELECT o_orderkey, o_custkey + (o_orderkey % 13 = 0)::INTEGER AS o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus
               FROM orders WHERE o_orderkey % 17 <> 0),
         c AS (SELECT coalesce(n.o_orderkey, l.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'only in legacy' WHEN l.o_orderkey IS NULL THEN 'only in current'
                 WHEN n.o_custkey <> l.o_custkey THEN 'other customer' WHEN n.o_orderstatus <> l.o_orderstatus THEN 'other state' ELSE 'same' END AS status
               FROM n FULL JOIN l ON n.o_orderkey = l.o_orderkey)"""


def _reconciled(t: Tables):
    key = F.col("o_orderkey")
    legacy = t.orders.where(key % 11 != 0)
    current = (
        t.orders.where(key % 17 != 0)
        .withColumn("o_custkey", F.col("o_custkey") + (key % 13 == 0).cast("int"))
        .withColumn("o_orderstatus", F.when(key % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    )
    return J.reconcile(
        legacy, current, ["o_orderkey"], {"o_custkey": "other customer", "o_orderstatus": "other state"}
    )


@query(RECONCILE + "SELECT o_orderkey, status FROM c")
def reconcile_versions(t: Tables):
    """Migration comparison: what is missing or different, per key."""
    return _reconciled(t).select("o_orderkey", "status")


@query(RECONCILE + "SELECT status, count(*) AS n FROM c GROUP BY 1")
def reconcile_summary(t: Tables):
    return _reconciled(t).groupBy("status").agg(F.count("*").alias("n"))


@query(
    """
    WITH f AS (SELECT s_suppkey, (s_suppkey * 37) % 400 AS cx, (s_suppkey * 13) % 150 AS cy FROM supplier),
         e AS (SELECT s_suppkey, cx + unnest([-6.0::DOUBLE, 7, 5, -4]) AS ax, cy + unnest([-5.0::DOUBLE, -4, 6, 3]) AS ay,
                      cx + unnest([7.0::DOUBLE, 5, -4, -6]) AS bx, cy + unnest([-4.0::DOUBLE, 6, 3, -5]) AS by_ FROM f)
    SELECT event_id, s_suppkey FROM events JOIN e ON (ay > user_id) <> (by_ > user_id) AND value < ax + (user_id - ay) * (bx - ax) / (by_ - ay)
    GROUP BY ALL HAVING count(*) % 2 = 1"""
)
def geofence_containment(t: Tables):
    """Points in polygons: grid squares give the candidates, ray casting decides."""
    cx, cy = (F.col("s_suppkey") * 37) % 400, (F.col("s_suppkey") * 13) % 150
    corners = [(-6.0, -5.0), (7.0, -4.0), (5.0, 6.0), (-4.0, 3.0)]
    ring = F.array(*[F.struct((cx + dx).alias("x"), (cy + dy).alias("y")) for dx, dy in corners])
    fences = t.supplier.select("s_suppkey", ring.alias("ring"))
    points = t.events.select("event_id", F.col("value").alias("px"), F.col("user_id").cast("double").alias("py"))
    return J.geofence_join(points, fences, "px", "py", "ring", cell=10.0).select("event_id", "s_suppkey")


@query(
    """
    WITH m AS (SELECT user_id AS u, time_bucket(INTERVAL 1 DAY, ts) AS s, count(*) AS day_events, round(sum(value), 2) AS day_total FROM events GROUP BY ALL)
    SELECT event_id, day_events, value / nullif(day_total, 0) AS share_of_day FROM events JOIN m ON user_id = u AND time_bucket(INTERVAL 1 DAY, ts) = s"""
)
def enrich_with_own_window(t: Tables):
    """Each event with the metric of its own window: aggregated first, joined on key and window."""
    day = t.events.withColumn("w", F.window("ts", "1 day")).withColumn("s", F.col("w.start")).drop("w")
    metric = day.groupBy("user_id", "s").agg(F.count("*").alias("day_events"), F.round(F.sum("value"), 2).alias("day_total"))
    return day.join(metric, ["user_id", "s"]).select(
        "event_id", "day_events", (F.col("value") / F.nullif("day_total", F.lit(0.0))).alias("share_of_day")
    )
