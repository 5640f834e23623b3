"""Model scoring with a declared output row, evaluation metrics, rule-based scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ml_predict(
    df: DataFrame,
    features: Sequence[str],
    load_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    output: str,
    name: str = "prediction",
) -> DataFrame:
    """Adds a struct column with the declared ``output`` fields.

    ``load_model`` runs once per Python worker and returns a function from a
    batch of features to a batch of outputs; rows cross as Arrow batches.
    """
    columns = list(features)

    @F.pandas_udf(output)
    def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for series in batches:
            yield model(pd.concat(series, axis=1, keys=columns))

    return df.withColumn(name, predict(*[F.col(c) for c in columns]))


def ml_evaluate(
    df: DataFrame, label: Column, prediction: Column, score: Column | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, precision, recall and F1 of a binary prediction; RMSE of ``score`` when given."""
    yes, said = label.cast("boolean"), prediction.cast("boolean")
    aggs = [
        F.count("*").alias("rows"),
        F.count_if(yes & said).alias("tp"),
        F.count_if(~yes & said).alias("fp"),
        F.count_if(yes & ~said).alias("fn"),
        F.count_if(~yes & ~said).alias("tn"),
    ]
    if score is not None:
        error = label.cast("double") - score
        aggs.append(F.sqrt(F.avg(error * error)).alias("rmse"))
    out = df.groupBy(*keys).agg(*aggs)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0)
    return (
        out.withColumn("accuracy", (tp + tn) / F.nullif(F.col("rows"), zero))
        .withColumn("precision", tp / F.nullif(tp + fp, zero))
        .withColumn("recall", tp / F.nullif(tp + fn, zero))
        .withColumn("f1", 2 * tp / F.nullif(2 * tp + fp + fn, zero))
    )


def rule_score(parts: Sequence[Sequence[tuple[Column, int]]]) -> Column:
    """A sum of parts; each part gives the points of its first rule that holds, else 0."""
    total = F.lit(0)
    for rules in parts:
        points = F.lit(0)
        for cond, value in reversed(rules):
            points = F.when(cond, value).otherwise(points)
        total = total + points
    return total


def band(value: Column, bounds: Mapping[str, float], otherwise: str) -> Column:
    """The first label, in the given order, whose bound ``value`` exceeds."""
    out = F.lit(otherwise)
    for label, bound in reversed(list(bounds.items())):
        out = F.when(value > bound, label).otherwise(out)
    return out
