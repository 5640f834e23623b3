"""Projection, filter and routing queries."""

from pyspark.sql import functions as F

from tidemill.functions import conditionals as C
from tidemill.functions import datetimes as D
from tidemill.operators import routing as R
from tidemill.plans.catalog import query
from tidemill.tables import Tables


@query("SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS amount FROM orders")
def project_and_alias(t: Tables):
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("amount")
    )


@query("SELECT *, l_extendedprice * l_quantity AS gross FROM lineitem")
def star_plus_columns(t: Tables):
    return t.lineitem.select("*", (F.col("l_extendedprice") * F.col("l_quantity")).alias("gross"))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, -l_quantity AS negated,
           l_extendedprice / nullif(l_quantity, 0) AS unit_price, l_orderkey % 7 AS remainder, l_quantity + 1 - 2 AS shifted,
           CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS tax_per_discount
    FROM lineitem"""
)
def computed_columns(t: Tables):
    c = F.col
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        (c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax"))).alias("charge"),
        (-c("l_quantity")).alias("negated"),
        C.safe_ratio(c("l_extendedprice"), c("l_quantity")).alias("unit_price"),
        (c("l_orderkey") % 7).alias("remainder"),
        (c("l_quantity") + 1 - 2).alias("shifted"),
        F.try_divide("l_tax", "l_discount").alias("tax_per_discount"),
    )


@query(
    """
    SELECT event_id FROM events
    WHERE (value > 50 AND value <= 300 AND event_type <> 'error') OR (NOT (user_id >= 10) AND value < 5 AND event_type = 'view')"""
)
def boolean_filter(t: Tables):
    c = F.col
    first = (c("value") > 50) & (c("value") <= 300) & (c("event_type") != "error")
    second = ~(c("user_id") >= 10) & (c("value") < 5) & (c("event_type") == "view")
    return t.events.where(first | second).select("event_id")


@query(
    """
    SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')
      AND nullif(o_orderstatus, 'P') NOT IN ('X')"""
)
def in_and_not_in(t: Tables):
    """NOT IN over a null is unknown, so the row is dropped."""
    c = F.col
    return t.orders.where(
        c("o_orderpriority").isin("1-URGENT", "2-HIGH")
        & ~c("o_orderstatus").isin("F")
        & ~F.nullif("o_orderstatus", F.lit("P")).isin("X")
    ).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'")
def between_bounds(t: Tables):
    when = F.col("l_shipdate").between(F.expr("timestamp_ntz'1997-01-01'"), F.expr("timestamp_ntz'1997-12-31'"))
    return t.lineitem.where(F.col("l_quantity").between(10, 20) & when).select("l_orderkey", "l_linenumber")


@query(
    """
    SELECT event_id, p IS NULL AS is_missing, p = '' AS is_empty
    FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN '' ELSE event_type END AS p FROM events)
    WHERE p IS NULL OR p IS NOT NULL AND p = ''"""
)
def null_is_not_empty(t: Tables):
    p = F.when(F.col("event_type") == "view", "").when(F.col("event_type") != "error", F.col("event_type"))
    rows = t.events.select("event_id", p.alias("p")).where(F.col("p").isNull() | (F.col("p").isNotNull() & (F.col("p") == "")))
    return rows.select("event_id", F.col("p").isNull().alias("is_missing"), (F.col("p") == "").alias("is_empty"))


@query("SELECT p_partkey, p_name LIKE 'small%' AS small, p_type ILIKE '%econ%' AS economy FROM part WHERE p_name LIKE '%ring' OR p_brand ILIKE 'brand#_'")
def like_and_ilike(t: Tables):
    return t.part.where(F.col("p_name").like("%ring") | F.col("p_brand").ilike("brand#_")).select(
        "p_partkey", F.col("p_name").like("small%").alias("small"), F.col("p_type").ilike("%econ%").alias("economy")
    )


@query(
    r"""
    SELECT page_id, regexp_matches(url, 'page=[0-9]+') AS has_page, regexp_full_match(url, 'https?://[^/]+/[a-z]{2}/.*') AS well_formed
    FROM pages WHERE regexp_matches(url, '^https?://m\.') OR regexp_matches(url, 'ref=')"""
)
def regexp_predicates(t: Tables):
    url = F.col("url")
    return t.pages.where(url.rlike(r"^https?://m\.") | url.rlike("ref=")).select(
        "page_id",
        url.rlike("page=[0-9]+").alias("has_page"),
        url.rlike("^(?:https?://[^/]+/[a-z]{2}/.*)$").alias("well_formed"),
    )


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT >= 90")
def nested_field_predicate(t: Tables):
    """A filter on a field inside a JSON member, through a declared struct."""
    return (
        t.events.withColumn("metadata", F.from_json("props", "k bigint"))
        .where(F.col("metadata.k") >= 90)
        .select("event_id", F.col("metadata.k").alias("k"))
    )


@query("SELECT event_id FROM events WHERE TRY_CAST(event_type AS DOUBLE) > 1 OR (props->>'$.nothing') = 'x' OR TRY_CAST(props->>'$.k' AS DOUBLE) < 5")
def missing_field_never_matches(t: Tables):
    """A missing or mistyped field makes the predicate null; the row is dropped, never an error."""
    d = t.events.withColumn("m", F.from_json("props", "k string, nothing string"))
    return d.where(
        (F.col("event_type").try_cast("double") > 1)
        | (F.col("m.nothing") == "x")
        | (F.col("m.k").try_cast("double") < 5)
    ).select("event_id")


@query(
    """
    SELECT event_id,
      CASE WHEN value >= 100 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS band,
      CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS code,
      CASE WHEN event_type = 'purchase' THEN CASE WHEN value > 50 THEN 'big' ELSE 'small' END END AS nested,
      CASE WHEN value > 20 THEN 'yes' ELSE 'no' END AS answer
    FROM events"""
)
def case_and_if(t: Tables):
    v, kind = F.col("value"), F.col("event_type")
    return t.events.select(
        "event_id",
        F.when(v >= 100, "high").when(v >= 10, "medium").otherwise("low").alias("band"),
        C.simple_case(kind, {"view": 1, "click": 2}, 0).alias("code"),
        F.when(kind == "purchase", F.when(v > 50, "big").otherwise("small")).alias("nested"),
        C.if_(v > 20, F.lit("yes"), F.lit("no")).alias("answer"),
    )


@query(
    """
    WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS a, CASE WHEN user_id % 2 = 0 THEN 10.0::DOUBLE END AS b FROM events)
    SELECT event_id, coalesce(a, b, 0) AS first_known, ifnull(a, -1) AS or_minus_one, coalesce(b, -2) AS nvl_b, nullif(b, 10.0) AS nullif_b,
           CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b, 5) END AS most,
           CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b, 5) END AS fewest
    FROM e"""
)
def null_handling(t: Tables):
    """COALESCE, IFNULL, NVL, NULLIF, and GREATEST/LEAST that are null for any null argument."""
    e = t.events.select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("value")).alias("a"),
        F.when(F.col("user_id") % 2 == 0, F.lit(10.0)).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return e.select(
        "event_id",
        F.coalesce(a, b, F.lit(0.0)).alias("first_known"),
        F.ifnull(a, F.lit(-1.0)).alias("or_minus_one"),
        F.nvl(b, F.lit(-2.0)).alias("nvl_b"),
        F.nullif(b, F.lit(10.0)).alias("nullif_b"),
        C.greatest(a, b, F.lit(5.0)).alias("most"),
        C.least(a, b, F.lit(5.0)).alias("fewest"),
    )


@query(
    """
    SELECT event_id, CAST(user_id AS VARCHAR) AS user_text, CAST(floor(value) AS BIGINT) AS whole, TRY_CAST(event_type AS INTEGER) AS not_a_number,
           TRY_CAST(substr(props, 7, 2) AS INTEGER) AS maybe, CAST(value AS DECIMAL(10,2))::DOUBLE AS exact, CAST(ts AS DATE) AS day
    FROM events"""
)
def casts(t: Tables):
    return t.events.select(
        "event_id",
        F.col("user_id").cast("string").alias("user_text"),
        F.floor("value").cast("long").alias("whole"),
        F.col("event_type").try_cast("int").alias("not_a_number"),
        F.substring("props", 7, 2).try_cast("int").alias("maybe"),
        F.col("value").cast("decimal(10,2)").cast("double").alias("exact"),
        F.col("ts").cast("date").alias("day"),
    )


@query("SELECT event_id, 'web' AS channel, 1 AS version FROM events")
def literal_tag(t: Tables):
    return t.events.select("event_id", F.lit("web").alias("channel"), F.lit(1).alias("version"))


@query(
    """
    SELECT bool_and(now_ts IS NOT NULL) AS all_set, count(DISTINCT now_ts) AS distinct_times
    FROM (SELECT current_timestamp AS now_ts FROM events)"""
)
def current_time_functions(t: Tables):
    """The clock functions are fixed once per query (or micro-batch), whatever the number of rows."""
    t.spark.conf.set("spark.sql.timeType.enabled", "true")  # CURRENT_TIME gives the TIME type
    e = t.events.select(
        F.current_timestamp().alias("now_ts"),
        F.now().alias("now"),
        F.localtimestamp().alias("local_ts"),
        F.current_date().alias("day"),
        F.current_time().alias("time"),
    )
    same = (F.col("now") == F.col("now_ts")) & (F.col("local_ts").cast("timestamp") == F.col("now_ts"))
    same = same & (F.col("now_ts").cast("date") == F.col("day")) & F.col("time").isNotNull()
    return e.agg(F.bool_and(same).alias("all_set"), F.count_distinct("now_ts").alias("distinct_times"))


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 HOUR AND ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY")
def relative_time_filter(t: Tables):
    """Relative to an explicit clock, so that the result can be repeated."""
    as_of = F.expr("timestamp_ntz'2024-01-20 00:00:00'")
    old = D.older_than(F.col("ts"), as_of, "1 hour")
    return t.events.where(old & ~D.older_than(F.col("ts"), as_of, "7 days")).select("event_id")


SUBQUERIES = """
    SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS largest_order
    FROM customer c
    WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'O')
      AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)"""


@query(SUBQUERIES)
def exists_and_scalar_subquery(t: Tables):
    """Correlated subqueries; the optimizer turns them into joins."""
    return t.sql(SUBQUERIES)


CTE = """
    WITH spend AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey),
         big AS (SELECT * FROM spend WHERE total > 1000000)
    SELECT s.c_mktsegment, count(*) AS customers, round(sum(b.total), 2) AS total
    FROM big b JOIN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0) s ON s.c_custkey = b.o_custkey
    GROUP BY s.c_mktsegment"""


@query(CTE)
def cte_and_derived_table(t: Tables):
    return t.sql(CTE)


@query(
    """
    WITH clean AS (SELECT * FROM events WHERE value > 1), hot AS (SELECT user_id, count(*) AS n FROM clean WHERE event_type = 'purchase' GROUP BY 1),
         seen AS (SELECT user_id, count(*) AS v FROM clean WHERE event_type = 'view' GROUP BY 1)
    SELECT coalesce(hot.user_id, seen.user_id) AS user_id, coalesce(n, 0) AS purchases, coalesce(v, 0) AS views,
           coalesce(n, 0) / nullif(v, 0) AS conversion
    FROM hot FULL JOIN seen ON hot.user_id = seen.user_id"""
)
def diamond_of_models(t: Tables):
    """One clean model read by two others and joined again. Both count by one key, so one pass serves them."""
    clean = t.events.where(F.col("value") > 1)

    def counted(kind):
        return F.count_if(F.col("event_type") == kind)

    wanted = clean.where(F.col("event_type").isin("purchase", "view"))
    both = wanted.groupBy("user_id").agg(counted("purchase").alias("purchases"), counted("view").alias("views"))
    return both.withColumn("conversion", C.safe_ratio(F.col("purchases"), F.col("views")))


@query(
    """
    SELECT user_id, CASE WHEN ('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 100 < 25 THEN 'canary' ELSE 'stable' END AS route, count(*) AS n
    FROM events GROUP BY ALL"""
)
def percentage_routing(t: Tables):
    """A quarter of the users go to the canary; each user always to the same side."""
    routed = R.route_percentage(t.events, "user_id", F.lit(25), R.md5_number)
    canary, stable = routed.where(F.col("route") == "canary"), routed.where(F.col("route") == "stable")
    return canary.unionByName(stable).groupBy("user_id", "route").agg(F.count("*").alias("n"))


def _reasons():
    return {
        "value_out_of_range": ~F.col("value").between(0.05, 300.0),
        "bad_type": F.col("event_type") == "error",
        "bad_user": F.col("user_id") < 3,
    }


REASON = """CASE WHEN value NOT BETWEEN 0.05 AND 300 THEN 'value_out_of_range' WHEN event_type = 'error' THEN 'bad_type' WHEN user_id < 3 THEN 'bad_user' END"""


@query(f"SELECT event_id, 'valid' AS output, NULL AS error_reason, NULL AS failed_at FROM events WHERE {REASON} IS NULL UNION ALL "
       f"SELECT event_id, 'dead' AS output, {REASON} AS error_reason, TIMESTAMP '2024-02-01' AS failed_at FROM events WHERE {REASON} IS NOT NULL")
def split_valid_and_dead_letters(t: Tables):
    valid, dead = R.split_valid(t.events, _reasons(), F.expr("timestamp_ntz'2024-02-01'"))
    good = valid.select("event_id", F.lit("valid").alias("output"))
    bad = dead.select("event_id", F.lit("dead").alias("output"), "error_reason", "failed_at")
    return good.unionByName(bad, allowMissingColumns=True)


@query(
    """
    SELECT event_id, 0 AS retry_count, 'work' AS output FROM events WHERE event_type <> 'error'
    UNION ALL SELECT event_id, user_id % 5 + 1, 'work' FROM events WHERE event_type = 'error' AND user_id % 5 < 3
    UNION ALL SELECT event_id, user_id % 5, 'dead' FROM events WHERE event_type = 'error' AND user_id % 5 >= 3"""
)
def merge_retries(t: Tables):
    """Fresh rows with retried ones; rows out of attempts leave as dead letters."""
    e = t.events.select("event_id", "event_type", "user_id")
    fresh = e.where(F.col("event_type") != "error").select("event_id")
    retry = e.where(F.col("event_type") == "error").select("event_id", (F.col("user_id") % 5).alias("retry_count"))
    work, spent = R.merge_retries(fresh, retry, 3)
    return work.withColumn("output", F.lit("work")).unionByName(spent.withColumn("output", F.lit("dead")))
