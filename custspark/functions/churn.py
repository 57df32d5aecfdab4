"""Churn label, risk bands, retention priority and health score.

Thresholds are strict, and a missing probability is never above one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds on the churn probability.
HIGH_THRESHOLD = 0.5
MEDIUM_THRESHOLD = 0.3

# Weights of the health score and the offset of its engagement share.
CHURN_WEIGHT = 0.4
ENGAGEMENT_WEIGHT = 0.3
NPS_WEIGHT = 0.3
ENGAGEMENT_OFFSET = 0.01


def _above(probability: Column, threshold: float) -> Column:
    """True above the threshold, not for NaN; the comparison alone can be pushed into a scan."""
    return (probability > F.lit(threshold)) & ~F.isnan(probability)


def is_at_risk(probability: Column) -> Column:
    """As a filter; missing gives NULL."""
    return _above(probability, HIGH_THRESHOLD)


def churn_label(probability: Column) -> Column:
    return F.coalesce(is_at_risk(probability), F.lit(False)).cast("int")


def _band(probability: Column, high: str, medium: str, low: str) -> Column:
    return (
        F.when(_above(probability, HIGH_THRESHOLD), F.lit(high))
        .when(_above(probability, MEDIUM_THRESHOLD), F.lit(medium))
        .otherwise(F.lit(low))
    )


def risk_band(probability: Column) -> Column:
    return _band(probability, "High Risk", "Medium Risk", "Low Risk")


def retention_priority(probability: Column) -> Column:
    return _band(probability, "HIGH", "MEDIUM", "LOW")


def health_score(probability: Column, engagement: Column, highest: Column, nps: Column) -> Column:
    """0 to 100: low churn risk, mail engagement relative to the best customer, promoter score."""
    calm = (F.lit(1.0) - probability) * F.lit(CHURN_WEIGHT)
    engaged = engagement / (highest + F.lit(ENGAGEMENT_OFFSET)) * F.lit(ENGAGEMENT_WEIGHT)
    promoter = (nps + F.lit(100)) / F.lit(200.0) * F.lit(NPS_WEIGHT)
    return (calm + engaged + promoter) * F.lit(100.0)


def highest_engagement(batch: DataFrame) -> Column:
    """The best ``email_engagement`` of a whole batch.

    An uncorrelated scalar subquery: Spark runs one pruned aggregate and puts
    its value into the generated code, with no join.
    """
    return batch.agg(F.max(F.nanvl("email_engagement", F.lit(None)))).scalar()


def with_health_score(
    df: DataFrame, probability: str = "churn_probability", reference_max: float | None = None
) -> DataFrame:
    """Add ``customer_health_score``; ``df`` needs ``email_engagement`` and ``nps_score``.

    ``reference_max`` takes the place of the batch's best engagement and makes
    a customer's score independent of the rest of the batch.
    """
    highest = highest_engagement(df) if reference_max is None else F.lit(float(reference_max))
    score = health_score(F.col(probability), F.col("email_engagement"), highest, F.col("nps_score"))
    return df.withColumn("customer_health_score", score)
