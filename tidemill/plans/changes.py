"""Change-data queries: ``orders`` of a customer stand for versions of one row, status F for a delete."""

from pyspark.sql import functions as F

from tidemill.operators import cdc as C
from tidemill.plans.catalog import query
from tidemill.tables import Tables

LATEST = """
    SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus
    FROM orders {where} GROUP BY 1"""


def _versions(t: Tables):
    return t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")


@query(LATEST.format(where=""))
def latest_row_per_key(t: Tables):
    return C.latest_per_key(_versions(t), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(f"SELECT * FROM ({LATEST.format(where='')}) WHERE o_orderstatus <> 'F'")
def current_state_without_deleted(t: Tables):
    """A delete hides the versions before it: the filter comes after the choice."""
    gone = F.col("o_orderstatus") == "F"
    return C.latest_per_key(_versions(t), ["o_custkey"], ["o_orderdate", "o_orderkey"], gone).drop("o_orderdate")


@query(LATEST.format(where="WHERE o_orderstatus <> 'F'"))
def latest_of_undeleted_rows(t: Tables):
    """The SQL text read literally: deletes are filtered first."""
    live = _versions(t).where(F.col("o_orderstatus") != "F")
    return C.latest_per_key(live, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'deleted' ELSE 'active' END AS status FROM orders")
def delete_as_status(t: Tables):
    return t.orders.select("o_orderkey", C.delete_status(F.col("o_orderstatus") == "F").alias("status"))


@query(
    """
    SELECT o_orderkey AS id, o_custkey AS customer_id, CASE WHEN o_orderstatus = 'P' THEN 'snapshot' ELSE 'live' END AS phase,
           o_orderstatus = 'F' AS deleted, o_orderdate AS changed_at FROM orders"""
)
def unwrap_change_events(t: Tables):
    """Change envelopes built from ``orders``, unwrapped to rows with a delete marker."""
    op = F.when(F.col("o_orderstatus") == "F", "d").when(F.col("o_orderstatus") == "P", "r").otherwise("u")
    row = F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"))
    wire = t.orders.select(
        F.to_json(
            F.struct(
                op.alias("op"),
                F.when(op == "d", row).alias("before"),
                F.when(op != "d", row).alias("after"),
                F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"),
            )
        ).alias("value")
    )
    return C.unwrap_changes(wire, "value", "id bigint, customer_id bigint").select(
        "id",
        "customer_id",
        F.col("__phase").alias("phase"),
        F.col("__deleted").alias("deleted"),
        F.col("__changed_at").alias("changed_at"),
    )


@query(
    """
    SELECT o_orderkey, coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), 'standard') AS tier, 'EUR' AS currency FROM orders"""
)
def schema_change_defaults(t: Tables):
    """A column added later is null in old rows, or absent: both take the default."""
    old = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("tier"))
    return C.with_defaults(old, tier="standard", currency="EUR")


@query(
    """
    SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to
    FROM orders"""
)
def validity_intervals(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return C.validity_intervals(rows, ["o_custkey"], "o_orderdate", ["o_orderkey"]).drop("o_orderdate")
