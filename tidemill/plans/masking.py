"""Masking, access and schema-contract queries."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators import masking as M
from tidemill.plans.catalog import query
from tidemill.tables import Tables


@query("SELECT c_custkey, sha256(c_name) AS name_hash, md5(c_name) AS name_md5, sha256(c_custkey::VARCHAR) AS key_hash FROM customer")
def mask_hash(t: Tables):
    name = F.col("c_name")
    return t.customer.select(
        "c_custkey",
        M.hash_mask(name).alias("name_hash"),
        M.hash_mask(name, "md5").alias("name_md5"),
        M.hash_mask(F.col("c_custkey")).alias("key_hash"),
    )


@query(
    """
    SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN '***' END AS redacted,
           regexp_replace(left(c_name, length(c_name) - 4), '[A-Za-z0-9]', '*', 'g') || right(c_name, 4) AS partial, NULL::DOUBLE AS balance
    FROM customer"""
)
def mask_redact_partial_null(t: Tables):
    return t.customer.select(
        "c_custkey",
        M.redact(F.col("c_name")).alias("redacted"),
        M.partial(F.col("c_name")).alias("partial"),
        F.lit(None).cast("double").alias("balance"),
    )


@query("SELECT 'tok_' || substr(sha256('pepper' || c_name), 1, 32) AS token, c_name AS restored, count(*) AS n FROM customer GROUP BY ALL")
def mask_tokenize(t: Tables):
    """Deterministic tokens, and the way back through the vault."""
    vault = M.token_vault(t.customer, "c_name", "pepper")
    masked = t.customer.withColumn("token", M.tokenize(F.col("c_name"), "pepper")).withColumn("restored", F.col("token"))
    return M.detokenize(masked, "restored", vault).groupBy("token", "restored").agg(F.count("*").alias("n"))


def _policies():
    return [
        M.MaskPolicy("c_name", "hash", ("analyst",)),
        M.MaskPolicy("c_acctbal", "null", ("analyst", "support")),
        M.MaskPolicy("c_mktsegment", "redact"),
    ]


@query(
    """
    SELECT 'analyst' AS reader, c_custkey, sha256(c_name) AS c_name, NULL::DOUBLE AS c_acctbal, '***' AS c_mktsegment FROM customer
    UNION ALL SELECT 'support', c_custkey, c_name, NULL, '***' FROM customer
    UNION ALL SELECT 'auditor', c_custkey, c_name, c_acctbal, '***' FROM customer"""
)
def role_scoped_masks(t: Tables):
    """The same table as three readers see it."""
    views = [
        M.masked_view(t.customer.drop("c_nationkey"), _policies(), role).select(F.lit(role).alias("reader"), "*")
        for role in ("analyst", "support", "auditor")
    ]
    return views[0].unionByName(views[1]).unionByName(views[2])


CLASSES = {"c_name": "sensitive", "c_acctbal": "highly_sensitive", "c_mktsegment": "internal", "c_custkey": "public"}


@query("SELECT c_custkey, sha256(c_name) AS c_name, NULL::DOUBLE AS c_acctbal, c_mktsegment FROM customer")
def classification_masks(t: Tables):
    """Masks follow from the classification of the columns."""
    df = t.customer.drop("c_nationkey")
    return M.classified_view(df, CLASSES, {"sensitive": "hash", "highly_sensitive": "null"}, "reader", cleared=("dpo",))


@query("""SELECT 'c_acctbal' AS "column", 'highly_sensitive' AS level, count(c_acctbal) AS exposed_rows FROM customer""")
def uncovered_sensitive_columns(t: Tables):
    """Sensitive columns without a mask, with the number of values they expose."""
    return M.uncovered_columns(t.customer, CLASSES, _policies()[:1])


@query("SELECT 'ops' AS reader, s_suppkey FROM supplier")
def row_access_by_role(t: Tables):
    """Allowed roles see the rows, others none."""
    views = [
        M.row_access(t.supplier, role, allow=("ops", "audit"), deny=("audit",)).select(F.lit(role).alias("reader"), "s_suppkey")
        for role in ("ops", "audit", "guest")
    ]
    return views[0].unionByName(views[1]).unionByName(views[2])


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def tenant_view(t: Tables):
    return M.tenant_view(t.customer, "c_nationkey", 7).select("c_custkey", "c_name")


@query("SELECT c_custkey, '' AS c_name, 0::DOUBLE AS c_acctbal, 0 AS c_nationkey FROM customer")
def blank_at_sink(t: Tables):
    """Fields that must stay in the record are written as their type's empty value."""
    return M.blank_columns(t.customer, ["c_name", "c_acctbal", "c_nationkey"]).drop("c_mktsegment")


@query("SELECT count(*) AS n, true AS all_restored, false AS any_plain FROM customer")
def encrypted_column(t: Tables):
    """AES-GCM and back. The key is derived here; a deployment reads it from its secret store."""
    key = F.unhex(F.md5(F.lit("not a real key")))
    sealed = t.customer.withColumn("sealed", M.encrypt(F.col("c_name"), key))
    opened = sealed.withColumn("opened", M.decrypt(F.col("sealed"), key))
    return opened.agg(
        F.count("*").alias("n"),
        F.bool_and(F.col("opened") == F.col("c_name")).alias("all_restored"),
        F.bool_or(F.contains("sealed", "c_name")).alias("any_plain"),
    )


@query(
    """
    WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_quantity * 100 > 2000 OR l_quantity <> floor(l_quantity)) AS x FROM lineitem)
    SELECT unnest(['l_orderkey', 'l_quantity', 'l_extendedprice', 'l_tax', 'l_comment']) AS "column",
           unnest(['same', 'same', 'retyped', 'removed', 'added']) AS change,
           unnest([0, 0, (SELECT count(*) FROM lineitem WHERE l_extendedprice <> floor(l_extendedprice)), n, 0]) AS affected_rows,
           unnest([true, true, (SELECT count(*) = 0 FROM lineitem WHERE l_extendedprice <> floor(l_extendedprice)), false, true]) AS compatible FROM c"""
)
def schema_evolution_check(t: Tables):
    """A batch held against a new schema, FULL mode: which columns would lose data."""
    target = T.StructType(
        [
            T.StructField("l_orderkey", T.LongType()),
            T.StructField("l_quantity", T.DoubleType()),
            T.StructField("l_extendedprice", T.LongType()),
            T.StructField("l_comment", T.StringType()),
        ]
    )
    return M.evolution_check(t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_tax"), target, "FULL")


@query("SELECT event_id, TRY_CAST(substr(event_type, 1, 1) AS INTEGER) AS event_type, NULL::VARCHAR AS note, CAST(floor(value) AS BIGINT) AS value FROM events")
def conform_to_new_schema(t: Tables):
    """Rows cast to a new schema: unreadable values and new columns are null."""
    target = T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("event_type", T.IntegerType()),
            T.StructField("note", T.StringType()),
            T.StructField("value", T.LongType()),
        ]
    )
    return M.conform(t.events, target)
