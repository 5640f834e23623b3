"""Model scoring and evaluation."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemill.operators import scoring as S
from tidemill.plans.catalog import query
from tidemill.tables import Tables

WEIGHTS = {"amount": 0.02, "items": -0.5, "bias": -0.25}


def load_model():
    """A logistic model; a real one is read from a file here, once per worker."""

    def predict(batch: pd.DataFrame) -> pd.DataFrame:
        z = WEIGHTS["amount"] * batch["amount"] + WEIGHTS["items"] * batch["items"] + WEIGHTS["bias"]
        p = 1 / (1 + np.exp(-z))
        band = np.where(p > 0.8, "high", np.where(p > 0.3, "medium", "low"))
        return pd.DataFrame({"is_fraud": p > 0.5, "confidence": p.round(6), "risk_category": band})

    return predict


def _scored(t: Tables):
    rows = t.events.select("event_id", "event_type", F.col("value").alias("amount"), (F.col("user_id") % 5).alias("items"))
    return S.ml_predict(rows, ["amount", "items"], load_model, "is_fraud boolean, confidence double, risk_category string")


SCORED = """
    WITH z AS (SELECT event_id, event_type, 1 / (1 + exp(-(0.02::DOUBLE * value + -0.5::DOUBLE * (user_id % 5) + -0.25::DOUBLE))) AS p FROM events)"""


@query(
    SCORED
    + """SELECT event_id, p > 0.5 AS is_fraud, round(p, 6) AS confidence, CASE WHEN p > 0.8 THEN 'high' WHEN p > 0.3 THEN 'medium' ELSE 'low' END AS risk_category FROM z"""
)
def ml_predict(t: Tables):
    """ML_PREDICT: a row of declared outputs, scored in Arrow batches."""
    return _scored(t).select("event_id", "prediction.*")


@query(
    SCORED
    + """, c AS (SELECT event_type IN ('purchase', 'error') AS y, p > 0.5 AS s FROM z),
       n AS (SELECT count(*) AS rows, count(*) FILTER (WHERE y AND s) AS tp, count(*) FILTER (WHERE NOT y AND s) AS fp, count(*) FILTER (WHERE y AND NOT s) AS fn,
                    count(*) FILTER (WHERE NOT y AND NOT s) AS tn FROM c)
    SELECT *, (tp + tn) / rows AS accuracy, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM n"""
)
def ml_evaluate(t: Tables):
    """ML_EVALUATE: metrics of the prediction against a label, as aggregates."""
    label = F.col("event_type").isin("purchase", "error")
    return S.ml_evaluate(_scored(t), label, F.col("prediction.is_fraud"))


@query(
    SCORED.replace("event_type,", "event_type, user_id % 5 AS segment,")
    + """SELECT segment, count(*) AS rows, round(sqrt(avg(pow((event_type IN ('purchase', 'error'))::INTEGER - round(p, 6), 2))), 6) AS rmse FROM z GROUP BY 1"""
)
def ml_evaluate_rmse(t: Tables):
    """Error of the model's confidence per segment."""
    label = F.col("event_type").isin("purchase", "error")
    out = S.ml_evaluate(_scored(t), label.cast("int"), F.col("prediction.is_fraud"), F.col("prediction.confidence"), ["items"])
    return out.select(F.col("items").alias("segment"), "rows", F.round("rmse", 6).alias("rmse"))


@query(
    """
    WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 7 WHEN 'O' THEN 1 ELSE 0 END + CASE WHEN month(o_orderdate) IN (11, 12) THEN 3 ELSE 0 END
                 + CASE WHEN o_orderpriority LIKE '1%' THEN 5 WHEN o_orderpriority LIKE '5%' THEN 2 ELSE 0 END + CASE WHEN c_mktsegment LIKE '%E%' THEN 1 ELSE 0 END AS points
               FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
    SELECT o_orderkey, points, CASE WHEN points > 9 THEN 'first' WHEN points > 5 THEN 'soon' WHEN points > 1 THEN 'later' ELSE 'last' END AS turn FROM s"""
)
def rule_based_score(t: Tables):
    """In which turn an order is handled: points for state, season, priority and segment, in bands."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    points = S.rule_score(
        [
            [(status == "P", 7), (status == "O", 1)],
            [(F.month("o_orderdate").isin(11, 12), 3)],
            [(priority.startswith("1"), 5), (priority.startswith("5"), 2)],
            [(F.col("c_mktsegment").contains("E"), 1)],
        ]
    )
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", points.alias("points")).withColumn("turn", S.band(F.col("points"), {"first": 9, "soon": 5, "later": 1}, "last"))
