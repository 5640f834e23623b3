"""Aggregation, sorting, set and generator queries."""

from pyspark.sql import functions as F

from tidemill.functions import conditionals as C
from tidemill.functions import json as J
from tidemill.plans.catalog import query
from tidemill.tables import Tables


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 2) AS total, max(ts) AS last_at FROM events GROUP BY ALL")
def group_by_keys(t: Tables):
    return t.events.groupBy("user_id", "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("ts").alias("last_at")
    )


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem")
def global_aggregate(t: Tables):
    return t.lineitem.agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_extendedprice"), 2).alias("total"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
    )


@query(
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
           round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc,
           round(sum(l_quantity), 2) / count(*) AS avg_qty, round(sum(l_extendedprice), 2) / count(*) AS avg_price
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL"""
)
def pricing_summary(t: Tables):
    c = F.col
    out = t.lineitem.where(c("l_shipdate") <= F.expr("timestamp_ntz'2001-09-02'")).groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 4).alias("sum_disc"),
    )
    return out.withColumn("avg_qty", c("sum_qty") / c("n")).withColumn("avg_price", c("sum_base") / c("n"))


@query(
    """
    SELECT l_suppkey, count(*) AS n, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned, count(nullif(l_linestatus, 'O')) AS not_open,
           count(DISTINCT l_partkey) AS parts, count(DISTINCT l_returnflag) AS flags
    FROM lineitem GROUP BY ALL"""
)
def count_variants(t: Tables):
    """COUNT(*), COUNT(x), COUNT(CASE …), exact COUNT(DISTINCT x)."""
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count(F.nullif("l_linestatus", F.lit("O"))).alias("not_open"),
        F.count_distinct("l_partkey").alias("parts"),
        F.count_distinct("l_returnflag").alias("flags"),
    )


@query(
    """
    SELECT event_type, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, min(event_type) AS low_text, max(ts) AS last_at
    FROM events GROUP BY ALL"""
)
def avg_min_max(t: Tables):
    return t.events.groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("mean"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.min("event_type").alias("low_text"),
        F.max("ts").alias("last_at"),
    )


@query(
    """
    SELECT event_type, round(stddev(value), 6) AS sd, round(stddev_pop(value), 6) AS sd_pop, round(stddev_samp(value), 6) AS sd_samp,
           round(var_pop(value), 4) AS v_pop, round(var_samp(value), 4) AS v_samp, round(variance(value), 4) AS v
    FROM events GROUP BY ALL"""
)
def spread(t: Tables):
    return t.events.groupBy("event_type").agg(
        F.round(F.stddev("value"), 6).alias("sd"),
        F.round(F.stddev_pop("value"), 6).alias("sd_pop"),
        F.round(F.stddev_samp("value"), 6).alias("sd_samp"),
        F.round(F.var_pop("value"), 4).alias("v_pop"),
        F.round(F.var_samp("value"), 4).alias("v_samp"),
        F.round(F.variance("value"), 4).alias("v"),
    )


@query(
    """
    SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_price, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status
    FROM orders GROUP BY ALL"""
)
def first_and_last_by_time(t: Tables):
    """FIRST_VALUE and LAST_VALUE as aggregates, with a unique tie-break."""
    order = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(
        F.min_by("o_totalprice", order).alias("first_price"), F.max_by("o_orderstatus", order).alias("last_status")
    )


@query(
    """
    SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS joined
    FROM events GROUP BY ALL"""
)
def collect_and_listagg(t: Tables):
    """COLLECT(DISTINCT x) and LISTAGG over a small domain, so the arrays stay bounded."""
    pairs = t.events.select("user_id", "event_type").distinct()
    return pairs.groupBy("user_id").agg(
        F.array_sort(F.collect_list("event_type")).alias("kinds"),
        F.expr("listagg(event_type, '|') WITHIN GROUP (ORDER BY event_type)").alias("joined"),
    )


@query("SELECT l_orderkey, list_sort(list(l_quantity)) AS quantities, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS parts FROM lineitem GROUP BY ALL")
def collect_lines_of_order(t: Tables):
    """COLLECT(x) with repeats; the group is one order."""
    return t.lineitem.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list("l_quantity")).alias("quantities"),
        F.expr("listagg(cast(l_partkey as string), ',') WITHIN GROUP (ORDER BY l_partkey)").alias("parts"),
    )


@query(
    """
    WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, '[' || string_agg('"' || event_type || '"', ',' ORDER BY event_type) || ']' AS kinds,
           '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS counts
    FROM c GROUP BY ALL"""
)
def json_aggregates(t: Tables):
    """JSON_ARRAYAGG and JSON_OBJECTAGG over one row per key and member."""
    counted = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counted.groupBy("user_id").agg(
        J.json_arrayagg(F.col("event_type")).alias("kinds"), J.json_objectagg(F.col("event_type"), F.col("n")).alias("counts")
    )


@query(
    """
    SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS finished,
           round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS open_total,
           round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE -o_totalprice END), 2) AS signed_position,
           round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) / nullif(round(sum(o_totalprice), 2), 0) AS finished_share
    FROM orders GROUP BY ALL"""
)
def conditional_sums(t: Tables):
    """Pivot-like sums, a signed position and a safe ratio in one pass."""
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    signed = F.when(F.col("o_orderpriority") == "1-URGENT", price).otherwise(-price)
    total, done = F.round(F.sum(price), 2), F.round(F.sum(F.when(status == "F", price)), 2)
    return t.orders.groupBy("o_custkey").agg(
        F.round(F.sum(F.when(status == "F", price).otherwise(0)), 2).alias("finished"),
        F.round(F.sum(F.when(status == "O", price).otherwise(0)), 2).alias("open_total"),
        F.round(F.sum(signed), 2).alias("signed_position"),
        C.safe_ratio(done, total).alias("finished_share"),
    )


@query(
    """
    SELECT l_partkey, round(sum(l_extendedprice * l_quantity), 2) / nullif(round(sum(l_quantity), 2), 0) AS vwap
    FROM lineitem GROUP BY l_partkey HAVING count(*) >= 30 AND sum(l_quantity) > 700"""
)
def weighted_price_having(t: Tables):
    c = F.col
    out = t.lineitem.groupBy("l_partkey").agg(
        F.count("*").alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("q"),
        F.round(F.sum(c("l_extendedprice") * c("l_quantity")), 2).alias("pv"),
    )
    return out.where((c("n") >= 30) & (c("q") > 700)).select("l_partkey", C.safe_ratio(c("pv"), c("q")).alias("vwap"))


@query("SELECT DISTINCT event_type, user_id % 10 AS shard FROM events")
def select_distinct(t: Tables):
    return t.events.select("event_type", (F.col("user_id") % 10).alias("shard")).distinct()


@query(
    """
    SELECT user_id, greatest(0, 100 - count(CASE WHEN event_type = 'error' THEN 1 END)) AS health,
           CASE WHEN count(*) > 70 AND max(value) > 200 THEN 'A' WHEN round(sum(value), 2) > 3000 THEN 'B' ELSE 'C' END AS grade
    FROM events GROUP BY ALL"""
)
def expressions_over_aggregates(t: Tables):
    a = t.events.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.max("value").alias("top"),
        F.round(F.sum("value"), 2).alias("total"),
    )
    grade = F.when((F.col("n") > 70) & (F.col("top") > 200), "A").when(F.col("total") > 3000, "B").otherwise("C")
    return a.select("user_id", F.greatest(F.lit(0), 100 - F.col("errors")).alias("health"), grade.alias("grade"))


@query("SELECT CAST(ts AS DATE) AS day, props->>'$.k' AS k, count(*) AS n FROM events GROUP BY ALL")
def group_by_expression(t: Tables):
    return t.events.groupBy(F.col("ts").cast("date").alias("day"), J.json_value(F.col("props"), "$.k").alias("k")).agg(
        F.count("*").alias("n")
    )


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def order_by(t: Tables):
    """Sorted by range partitioning, not in one task."""
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k_report(t: Tables):
    """ORDER BY … LIMIT: each task keeps its best 25 rows."""
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(
    """
    SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier
    UNION ALL SELECT 'urgent', o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'"""
)
def union_all(t: Tables):
    def part(df, kind, key, amount):
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(amount).alias("balance"))

    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT")
    return (
        part(t.customer, "customer", "c_custkey", "c_acctbal")
        .unionByName(part(t.supplier, "supplier", "s_suppkey", "s_acctbal"))
        .unionByName(part(urgent, "urgent", "o_orderkey", "o_totalprice"))
    )


@query("SELECT vec_id, i AS position, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)")
def unnest_array(t: Tables):
    """CROSS JOIN UNNEST with ordinality."""
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("p", "v")).select(
        "vec_id", (F.col("p") + 1).cast("long").alias("position"), F.col("v").cast("double").alias("x")
    )


@query("SELECT page_id, w AS segment, count(*) AS n FROM pages, unnest(string_split(url, '/')) AS u(w) GROUP BY ALL")
def lateral_split(t: Tables):
    """LATERAL TABLE(SPLIT(url, '/')) as a join with a generator."""
    t.pages.createOrReplaceTempView("pages")
    return t.spark.sql(
        "SELECT page_id, w AS segment, count(*) AS n FROM pages, LATERAL explode(split(url, '/')) AS u(w) GROUP BY page_id, w"
    )


@query("SELECT doc_id, length(w)::INTEGER AS word_length, count(*) AS n FROM documents, unnest(string_split(text, ' ')) AS u(w) WHERE w <> '' GROUP BY ALL")
def table_function_words(t: Tables):
    """A table function per row (EXPLODE of a split) followed by an aggregate over whole texts."""
    words = t.documents.select("doc_id", F.explode(F.split("text", " ")).alias("w")).where(F.col("w") != "")
    return words.groupBy("doc_id", F.length("w").alias("word_length")).agg(F.count("*").alias("n"))
