"""Score customers with the fitted models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custspark.functions.churn import health_score, highest_engagement, retention_priority
from custspark.functions.missing import nan_to_null
from custspark.functions.scores import with_engagement
from custspark.operators.encoding import decode_segment
from custspark.operators.features import assemble, with_features
from custspark.operators.train import CustomerModels
from custspark.schema import SCORING_COLUMNS

# Tasks per core that score: a row of a few hundred bytes goes through hundreds of trees, so the files' sizes
# say nothing of the work, and a table in one file would be scored by one task.
TASKS_PER_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """The columns that scoring reads, with the rows dealt to all cores."""
    return df.select(*SCORING_COLUMNS).repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def score(
    df: DataFrame,
    models: CustomerModels,
    reference_max: float | None = None,
    handle_invalid: str = "error",
) -> DataFrame:
    """One row per customer: probabilities, predictions, health score and priority.

    One plan without a shuffle; the best engagement of the batch is the only
    other pass and reads two columns, or all features where rows may be skipped. Known labels of the input, such as its
    own ``churn_probability``, do not reach the result, and no column beyond the features' is looked at: a table
    that holds earlier scores can be scored again.
    """
    inputs = df.select(*SCORING_COLUMNS)
    rows = assemble(with_features(inputs, models.encoding), handle_invalid=handle_invalid)
    if reference_max is not None:
        highest = F.lit(float(reference_max))
    elif handle_invalid == "skip":
        # Only customers that are scored set the scale; which these are depends on all features.
        highest = highest_engagement(rows)
    else:
        highest = highest_engagement(with_engagement(nan_to_null(inputs)))
    predicted = decode_segment(
        models.predict(rows), models.segment_labels, "predicted_segment_label", "predicted_segment"
    ).withColumn("churn_probability", vector_to_array("churn_vector")[1])
    return predicted.select(
        "customer_id",
        "churn_probability",
        F.col("will_churn").cast("int").alias("will_churn"),
        "predicted_clv",
        "predicted_frequency",
        "predicted_segment",
        health_score(F.col("churn_probability"), F.col("email_engagement"), highest, F.col("nps_score")).alias(
            "customer_health_score"
        ),
        retention_priority(F.col("churn_probability")).alias("retention_priority"),
    )
