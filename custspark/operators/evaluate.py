"""Metrics of predictions, as plain aggregates that share one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(label: Column, prediction: Column) -> Column:
    """Share of equal labels and predictions."""
    return F.avg((label.cast("double") == prediction.cast("double")).cast("double"))


def mean_absolute_error(label: Column, prediction: Column) -> Column:
    return F.avg(F.abs(label.cast("double") - prediction.cast("double")))


def r2(label: Column, prediction: Column) -> Column:
    """1 - residual / total sum of squares, over rows with both; for a constant label 1 if all is right, else 0."""
    both = label.isNotNull() & prediction.isNotNull()
    label, prediction = F.when(both, label.cast("double")), F.when(both, prediction.cast("double"))
    residual = F.avg(F.pow(label - prediction, F.lit(2.0)))
    total = F.var_pop(label)
    constant = F.when(residual == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(total == 0, constant).otherwise(F.lit(1.0) - F.try_divide(residual, total))


def as_rows(df: DataFrame, metrics: dict[tuple[str, str], Column]) -> DataFrame:
    """Evaluate all (model, metric) aggregates in one pass and give one row for each."""
    names = list(metrics)
    wide = df.agg(*[metrics[n].alias(f"m{i}") for i, n in enumerate(names)])
    rows = F.array(
        *[
            F.struct(F.lit(model).alias("model"), F.lit(metric).alias("metric"), F.col(f"m{i}").alias("value"))
            for i, (model, metric) in enumerate(names)
        ]
    )
    return wide.select(F.inline(rows))
