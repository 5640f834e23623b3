"""Data-quality queries."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators import quality as Q
from tidemill.operators.routing import split_valid
from tidemill.plans.catalog import query
from tidemill.tables import Tables

AT = "TIMESTAMP '2024-02-01 00:00:00'"


def _at():
    return F.expr("timestamp_ntz'2024-02-01 00:00:00'")


def _messages(t: Tables):
    """Events as loosely typed text messages: some fields missing, mistyped or out of range."""
    return t.events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("user_id") % 7 != 0, F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("status"),
        F.when(F.col("user_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("amount"),
        F.col("ts"),
        F.col("value"),
    )


MESSAGES = """
    WITH m AS (SELECT event_id::VARCHAR AS event_id, CASE WHEN user_id % 7 <> 0 THEN user_id::VARCHAR END AS user_id,
                      CASE WHEN event_type <> 'error' THEN event_type END AS status,
                      CASE WHEN user_id % 5 = 0 THEN 'n/a' ELSE value::VARCHAR END AS amount, ts, value FROM events) """


def _checks():
    return [
        *Q.not_null("event_id", "user_id"),
        *Q.accepted_values("status", ["view", "click", "purchase"]),
        *Q.value_range("amount", 0.5, 100),
        *Q.accepted_types({"amount": "number", "event_id": "int"}),
        *Q.custom_sql("cheap_purchase", "status = 'purchase' AND value < 1", "event_id"),
    ]


BROKEN = [
    ("not_null:event_id", "event_id IS NULL", "event_id"),
    ("not_null:user_id", "user_id IS NULL", "user_id"),
    ("accepted_values:status", "status NOT IN ('view', 'click', 'purchase')", "status"),
    ("range_min:amount", "TRY_CAST(amount AS DOUBLE) < 0.5", "amount"),
    ("range_max:amount", "TRY_CAST(amount AS DOUBLE) > 100", "amount"),
    ("accepted_types:amount", "TRY_CAST(amount AS DOUBLE) IS NULL AND amount IS NOT NULL", "amount"),
    ("accepted_types:event_id", "TRY_CAST(event_id AS INTEGER) IS NULL AND event_id IS NOT NULL", "event_id"),
    ("custom_sql:cheap_purchase", "status = 'purchase' AND value < 1", "event_id"),
]
VIOLATIONS = MESSAGES + " UNION ALL ".join(
    f"SELECT 'event_checks' AS test_name, '{label}' AS violation_type, {detail} AS violation_details, event_id AS record, {AT} AS detected_at "
    f"FROM m WHERE {cond}"
    for label, cond, detail in BROKEN
)


def violations_of(messages, at):
    """The violation rows of a frame of messages, batch or stream."""
    return Q.violations(messages, "event_checks", _checks(), at, F.col("event_id"))


@query(VIOLATIONS)
def violation_rows(t: Tables):
    """not_null, accepted_values, range, accepted_types and custom_sql from a single scan."""
    return violations_of(_messages(t), _at())


def _union_results(rows):
    return " UNION ALL ".join(
        f"SELECT 'event_checks' AS test_name, '{label}' AS assertion, count(*) AS checked, count(*) FILTER (WHERE {cond}) AS failures, "
        f"count(*) FILTER (WHERE {cond}) / count(*) AS observed, count(*) FILTER (WHERE {cond}) = 0 AS passed FROM m"
        for label, cond, _ in rows
    )


@query(MESSAGES + _union_results(BROKEN))
def check_results(t: Tables):
    """Pass or fail per assertion, from one aggregate."""
    return Q.check_results(_messages(t), "event_checks", _checks())


@query(
    MESSAGES
    + """SELECT 'status' AS "column", count(DISTINCT coalesce(status, 'None')) AS invalid_values, count(*) AS invalid_rows,
         (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT coalesce(status, 'None') AS s FROM m WHERE coalesce(status, 'None') NOT IN ('view', 'click') ORDER BY 1 LIMIT 5)) AS examples
         FROM m WHERE coalesce(status, 'None') NOT IN ('view', 'click')"""
)
def accepted_values_report(t: Tables):
    """Sample-mode reading of accepted values: null is invalid, with up to five examples."""
    return Q.invalid_value_report(_messages(t), "status", ["view", "click"])


@query(
    """
    SELECT 'sample' AS test_name, l AS assertion, count(*) AS checked, count(*) FILTER (WHERE bad) AS failures,
           count(*) FILTER (WHERE bad) / count(*) AS observed, count(*) FILTER (WHERE bad) = 0 AS passed
    FROM (SELECT unnest(['range_min:value', 'range_max:value']) AS l, unnest([value < 1, value > 50]) AS bad
          FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 100)) GROUP BY ALL"""
)
def sample_test(t: Tables):
    """Assertions over the first 100 messages of the topic, as a sample test reads them."""
    sample = t.events.orderBy("ts", "event_id").limit(100)
    return Q.check_results(sample, "sample", Q.value_range("value", 1, 50))


@query(
    """
    WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT 'lines' AS test_name, 'unique_key:l_orderkey,l_linenumber' AS assertion, sum(n)::BIGINT AS checked, count(*) FILTER (WHERE n > 1) AS failures,
           count(*) FILTER (WHERE n > 1) / sum(n) AS observed, count(*) FILTER (WHERE n > 1) / sum(n) <= 0.1 AS passed FROM k"""
)
def unique_key_with_tolerance(t: Tables):
    return Q.unique_key_result(t.lineitem, "lines", ["l_orderkey", "l_linenumber"], 0.1)


@query(
    """
    WITH k AS (SELECT user_id, event_type, time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n FROM events GROUP BY ALL)
    SELECT 'hourly' AS test_name, 'unique_key:user_id,event_type' AS assertion, sum(n)::BIGINT AS checked, count(*) FILTER (WHERE n > 1) AS failures,
           count(*) FILTER (WHERE n > 1) / sum(n) AS observed, count(*) FILTER (WHERE n > 1) = 0 AS passed FROM k"""
)
def unique_key_in_window(t: Tables):
    return Q.unique_key_result(t.events, "hourly", ["user_id", "event_type"], ts="ts", window="1 hour")


@query(
    """
    SELECT 'known_users' AS test_name, 'foreign_key:user_id' AS assertion, count(user_id) AS checked,
           count(*) FILTER (WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS failures,
           1 - count(*) FILTER (WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) / count(user_id) AS observed,
           1 - count(*) FILTER (WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) / count(user_id) >= 0.8 AS passed
    FROM events"""
)
def foreign_key_match_rate(t: Tables):
    return Q.foreign_key_result(
        t.events, "known_users", "user_id", t.customer.where(F.col("c_acctbal") > 0), "c_custkey", 0.8
    )


@query(
    """
    WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'view'),
         f AS (SELECT p.event_id, count(v.ts) > 0 AS hit FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts + INTERVAL 6 HOUR GROUP BY 1)
    SELECT 'seen_before' AS test_name, 'foreign_key:user_id' AS assertion, count(*) AS checked, count(*) FILTER (WHERE NOT hit) AS failures,
           1 - count(*) FILTER (WHERE NOT hit) / count(*) AS observed, false AS passed FROM f"""
)
def foreign_key_in_window(t: Tables):
    """A purchase must have a view of the same user within six hours."""
    bought = t.events.where(F.col("event_type") == "purchase")
    viewed = t.events.where(F.col("event_type") == "view")
    return Q.foreign_key_window_result(
        bought, "seen_before", "user_id", "ts", viewed.select("user_id", "ts"), "user_id", "ts", "6 hours"
    )


@query(
    """
    WITH c AS (SELECT count(value) AS n, count(*) FILTER (WHERE value >= 0 AND value < 10) AS a, count(*) FILTER (WHERE value >= 10 AND value < 100) AS b,
                      count(*) FILTER (WHERE value >= 100) AS d FROM events)
    SELECT 'values' AS test_name, 'distribution:value[0,10)' AS assertion, n AS checked, CASE WHEN abs(a / n - 0.2) <= 0.05 THEN 0 ELSE a END AS failures, a / n AS observed, abs(a / n - 0.2) <= 0.05 AS passed FROM c
    UNION ALL SELECT 'values', 'distribution:value[10,100)', n, CASE WHEN abs(b / n - 0.2) <= 0.05 THEN 0 ELSE b END, b / n, abs(b / n - 0.2) <= 0.05 FROM c
    UNION ALL SELECT 'values', 'distribution:value[100,)', n, CASE WHEN d / n <= 0.15 THEN 0 ELSE d END, d / n, d / n <= 0.15 FROM c"""
)
def distribution_buckets(t: Tables):
    buckets = [
        {"min": 0, "max": 10, "expected_ratio": 0.2, "tolerance": 0.05},
        {"min": 10, "max": 100, "expected_ratio": 0.2, "tolerance": 0.05},
        {"min": 100, "max_ratio": 0.15},
    ]
    return Q.distribution_result(t.events, "values", "value", buckets)


@query("SELECT assertion, checked, failures, observed > 45 AND observed < 60 AS plausible, passed FROM (SELECT 'distribution:value:max_stddev' AS assertion, count(value) AS checked, (stddev(value) > 100)::BIGINT AS failures, stddev(value) AS observed, stddev(value) <= 100 AS passed FROM events)")
def distribution_stddev(t: Tables):
    r = Q.stddev_result(t.events, "values", "value", 100.0)
    return r.select("assertion", "checked", "failures", F.col("observed").between(45, 60).alias("plausible"), "passed")


@query(
    f"""
    SELECT 'lag' AS test_name, 'max_lag:ts' AS violation_type, datesub('second', ts, {AT})::VARCHAR AS violation_details, event_id::VARCHAR AS record, {AT} AS detected_at
    FROM events WHERE datesub('second', ts, {AT}) > 86400 * 5"""
)
def max_lag_violations(t: Tables):
    """Rows older than five days at the reader's clock, in whole elapsed seconds."""
    checks = Q.max_lag("ts", 86400 * 5, _at())
    return Q.violations(t.events, "lag", checks, _at(), F.col("event_id").cast("string"))


@query(
    """
    WITH w AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS w, count(*) AS n FROM events GROUP BY 1),
         s AS (SELECT date_diff('minute', min(w), max(w)) // 10 + 1 AS spans, count(*) AS seen, sum(n) AS total, count(*) FILTER (WHERE n < 1 OR n > 6) AS bad FROM w)
    SELECT 'rate' AS test_name, 'throughput:10 minutes' AS assertion, spans AS checked, (bad + spans - seen)::BIGINT AS failures, total / spans AS observed, bad + spans - seen = 0 AS passed FROM s"""
)
def throughput_per_window(t: Tables):
    """Rows per ten minutes between bounds; windows without rows count as 0."""
    return Q.throughput_result(t.events, "rate", "ts", "10 minutes", 1, 6)


FRESH = """
    SELECT {key} max(ts) AS newest, datesub('second', max(ts), TIMESTAMP '2024-01-31') AS age_seconds,
           CASE WHEN datesub('second', max(ts), TIMESTAMP '2024-01-31') > {error} THEN 'error'
                WHEN datesub('second', max(ts), TIMESTAMP '2024-01-31') > {warn} THEN 'warn' ELSE 'ok' END AS status
    FROM events {group}"""


@query(FRESH.format(key="", warn=60, error=3600, group=""))
def freshness_of_source(t: Tables):
    return Q.freshness(t.events, "ts", F.expr("timestamp_ntz'2024-01-31'"), 60, 3600)


@query(FRESH.format(key="user_id,", warn=6 * 3600, error=12 * 3600, group="GROUP BY user_id"))
def freshness_per_key(t: Tables):
    return Q.freshness(t.events, "ts", F.expr("timestamp_ntz'2024-01-31'"), 6 * 3600, 12 * 3600, ["user_id"])


@query(
    f"""
    SELECT 'rows' AS test_name, 'positive:c_acctbal' AS violation_type, c_acctbal::VARCHAR AS violation_details, c_custkey::VARCHAR AS record, {AT} AS detected_at
    FROM customer WHERE c_acctbal <= 0
    UNION ALL SELECT 'rows', 'expression:segment_known', c_mktsegment, c_custkey::VARCHAR, {AT} FROM customer WHERE NOT (length(c_mktsegment) > 8 OR c_nationkey < 20)"""
)
def positive_and_expression(t: Tables):
    checks = [
        *Q.positive("c_acctbal"),
        *Q.expression("segment_known", "length(c_mktsegment) > 8 OR c_nationkey < 20", "c_mktsegment"),
    ]
    return Q.violations(t.customer, "rows", checks, _at(), F.col("c_custkey").cast("string"))


@query(
    """
    SELECT 'no_orphans' AS test_name, 'custom_sql' AS assertion, 1::BIGINT AS checked, 0::BIGINT AS failures, 0::DOUBLE AS observed, true AS passed
    WHERE (SELECT count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey) = 0
    UNION ALL SELECT 'few_bad', 'custom_sql', count(*), count(*), count(*), count(*) <= 100 FROM orders WHERE o_totalprice > 499000"""
)
def custom_sql_expectations(t: Tables):
    """A query whose value must equal 0, and one that may return at most 100 rows."""
    orphans = t.sql("SELECT count(*) AS n FROM orders LEFT ANTI JOIN customer ON o_custkey = c_custkey")
    bad = t.orders.where(F.col("o_totalprice") > 499000)
    return Q.scalar_result(orphans, "no_orphans", expect=0).unionByName(Q.scalar_result(bad, "few_bad", max_failures=100))


COLUMN_TESTS = {
    "o_orderstatus": ["not_null", {"accepted_values": ["F", "O"]}],
    "o_totalprice": ["positive", {"range": {"min": 1000, "max": 450000}}],
    "o_orderkey": ["unique", "not_null"],
}


@query(
    """
    WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS a, count(*) FILTER (WHERE o_totalprice < 1000) AS lo,
                      count(*) FILTER (WHERE o_totalprice > 450000) AS hi, count(*) - count(DISTINCT o_orderkey) AS dup FROM orders)
    SELECT 'orders_columns' AS test_name, unnest(['not_null:o_orderstatus', 'accepted_values:o_orderstatus', 'positive:o_totalprice', 'range_min:o_totalprice', 'range_max:o_totalprice', 'not_null:o_orderkey', 'unique_key:o_orderkey']) AS assertion,
           unnest([0, a, 0, lo, hi, 0, dup]) AS failures, unnest([true, a = 0, true, lo = 0, hi = 0, true, dup = 0]) AS passed FROM c"""
)
def column_level_tests(t: Tables):
    """Tests declared on source columns, expanded to the same checks."""
    rows = Q.check_results(t.orders, "orders_columns", Q.column_checks(COLUMN_TESTS))
    keys = [Q.unique_key_result(t.orders, "orders_columns", [c]) for c, tests in COLUMN_TESTS.items() if "unique" in tests]
    for k in keys:
        rows = rows.unionByName(k)
    return rows.select("test_name", "assertion", "failures", "passed")


@query(
    MESSAGES
    + f"""SELECT event_id, CASE WHEN size = 0 THEN 'good' ELSE 'dead' END AS output, CASE WHEN size > 0 THEN error END AS error, CASE WHEN size > 0 THEN {AT} END AS failed_at, CASE WHEN size > 0 THEN 'events' END AS topic
      FROM (SELECT event_id, len(v) AS size, array_to_string(v, ';') AS error FROM (SELECT event_id, list_filter(["""
    + ", ".join(f"CASE WHEN {cond} THEN '{label}' END" for label, cond, _ in BROKEN)
    + "], lambda x: x IS NOT NULL) AS v FROM m))"
)
def failing_rows_to_dead_letters(t: Tables):
    """on_failure: failing rows leave with their reasons and metadata, good rows go on."""
    good, bad = Q.split_on_checks(_messages(t), _checks(), metadata={"failed_at": _at(), "topic": F.lit("events")})
    dead = bad.select("event_id", F.lit("dead").alias("output"), "error", "failed_at", "topic")
    return good.select("event_id", F.lit("good").alias("output")).unionByName(dead, allowMissingColumns=True)


@query(
    MESSAGES
    + f""", r AS ({_union_results(BROKEN)})
    SELECT test_name, CASE WHEN assertion LIKE 'accepted%' THEN 'warning' ELSE 'error' END AS severity, count(*) AS assertions,
           count(*) FILTER (WHERE NOT passed) AS failed, sum(failures)::BIGINT AS failures, count(*) FILTER (WHERE NOT passed) = 0 AS passed
    FROM r GROUP BY ALL UNION ALL SELECT 'odd', 'error', 1, 0, 0, true"""
)
def test_summary(t: Tables):
    """Pass or fail per test and severity; an unknown assertion passes with a warning label."""
    checked = Q.check_results(_messages(t), "event_checks", _checks())
    odd = Q.unknown_assertion(t.events, "odd", "looks_nice")
    return Q.summarize(checked, odd, severity={"accepted": "warning"})


@query(
    """
    SELECT * FROM (VALUES ('o_orderkey', 'bigint', 'bigint', 0::BIGINT, 'ok'), ('o_custkey', 'string', 'bigint', 0, 'type_mismatch'),
      ('o_totalprice', 'double', 'double', (SELECT count(*) FROM orders WHERE o_totalprice < 50000), 'null_violation'), ('o_note', 'string', NULL, NULL, 'missing'),
      ('o_orderdate', NULL, 'timestamp_ntz', 0, 'undeclared')) v("column", expected, actual, nulls, status)"""
)
def schema_contract_check(t: Tables):
    """Declared contract against the data: types, missing and extra columns, NOT NULL."""
    contract = T.StructType(
        [
            T.StructField("o_orderkey", T.LongType(), False),
            T.StructField("o_custkey", T.StringType()),
            T.StructField("o_totalprice", T.DoubleType(), False),
            T.StructField("o_note", T.StringType()),
        ]
    )
    price = F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("o_totalprice")
    return Q.schema_check(t.orders.select("o_orderkey", "o_custkey", price, "o_orderdate"), contract)


@query("SELECT CASE WHEN o_totalprice <= 1000 THEN 'not_positive' WHEN o_orderstatus = 'P' THEN 'pending' END AS error_reason, count(*) AS n FROM orders GROUP BY 1")
def dead_letter_reasons(t: Tables):
    """How many rows each reason sends away."""
    reasons = {"not_positive": F.col("o_totalprice") <= 1000, "pending": F.col("o_orderstatus") == "P"}
    valid, dead = split_valid(t.orders, reasons, _at())
    tagged = valid.select(F.lit(None).cast("string").alias("error_reason")).unionByName(dead.select("error_reason"))
    return tagged.groupBy("error_reason").agg(F.count("*").alias("n"))
