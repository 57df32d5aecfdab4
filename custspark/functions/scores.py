"""Recency, frequency, monetary and engagement scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recency_score(days: Column) -> Column:
    """1 / (days + 1); NULL one day before zero, where the quotient has no value."""
    return F.try_divide(F.lit(1.0), days + F.lit(1))


def log_score(value: Column) -> Column:
    """ln(1 + value); NULL at -1 and below."""
    return F.log1p(value)


def engagement_score(sessions: Column, seconds: Column) -> Column:
    """Thousands of seconds spent in sessions."""
    return sessions.cast("double") * seconds.cast("double") / F.lit(1000.0)


def email_engagement(open_rate: Column, click_rate: Column) -> Column:
    """Share of mails both opened and clicked."""
    return open_rate * click_rate


def with_rfm_scores(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "recency_score": recency_score(F.col("last_purchase_days")),
            "frequency_score": log_score(F.col("purchase_frequency")),
            "monetary_score": log_score(F.col("total_spent")),
        }
    )


def with_engagement(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "engagement_score": engagement_score(F.col("session_count"), F.col("avg_session_duration")),
            "email_engagement": email_engagement(F.col("email_open_rate"), F.col("click_through_rate")),
        }
    )


def with_scores(df: DataFrame) -> DataFrame:
    return with_engagement(with_rfm_scores(df))
