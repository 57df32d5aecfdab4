import math

import pytest
from edge import edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from custspark.functions import churn, missing, scores


def by_id(df, column):
    return {r["customer_id"]: r[column] for r in df.select("customer_id", column).collect()}


def test_thresholds_are_strict_and_missing_is_low(spark):
    p = F.col("churn_probability")
    df = edge_rows(spark).select(
        "customer_id",
        churn.churn_label(p).alias("label"),
        churn.risk_band(p).alias("band"),
        churn.retention_priority(p).alias("priority"),
    )
    rows = {r["customer_id"]: (r["label"], r["band"], r["priority"]) for r in df.collect()}
    assert rows["c01"] == (0, "Low Risk", "LOW")
    assert rows["c02"] == (0, "Medium Risk", "MEDIUM")
    assert rows["c03"] == (0, "Medium Risk", "MEDIUM")
    assert rows["c04"] == (1, "High Risk", "HIGH")
    assert rows["c05"] == rows["c06"] == (0, "Low Risk", "LOW")


def test_nan_becomes_null_and_text_stays(spark):
    cleaned = missing.nan_to_null(edge_rows(spark))
    assert by_id(cleaned, "churn_probability")["c06"] is None
    assert cleaned.dtypes == edge_rows(spark).dtypes


def test_scores(spark):
    rows = {r["customer_id"]: r for r in scores.with_scores(edge_rows(spark)).collect()}
    usual, empty, bad = rows["c00"], rows["c10"], rows["c09"]
    assert usual["recency_score"] == 0.1
    assert usual["frequency_score"] == pytest.approx(math.log1p(5))
    assert usual["monetary_score"] == pytest.approx(math.log1p(500.0))
    assert usual["engagement_score"] == 3.0
    assert usual["email_engagement"] == pytest.approx(0.2)
    assert (empty["frequency_score"], empty["monetary_score"]) == (0.0, 0.0)
    assert (bad["recency_score"], bad["frequency_score"], bad["monetary_score"]) == (None, None, None)


def test_health_score_of_one_row_uses_its_own_engagement(spark):
    df = scores.with_engagement(edge_rows(spark, [{}]))
    got = churn.with_health_score(df).first()["customer_health_score"]
    assert got == pytest.approx((0.8 * 0.4 + 0.2 / 0.21 * 0.3 + 120 / 200 * 0.3) * 100)
    fixed = churn.with_health_score(df, reference_max=0.99).first()["customer_health_score"]
    assert fixed == pytest.approx((0.8 * 0.4 + 0.2 / 1.0 * 0.3 + 120 / 200 * 0.3) * 100)


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.tuples(st.floats(0, 1), st.floats(0, 1), st.floats(0, 1), st.integers(-100, 100)), min_size=1, max_size=20
    )
)
def test_health_score_stays_between_0_and_100(spark, values):
    df = spark.createDataFrame(
        values, "churn_probability double, email_open_rate double, click_through_rate double, nps_score bigint"
    ).withColumn("email_engagement", scores.email_engagement(F.col("email_open_rate"), F.col("click_through_rate")))
    got = [r["customer_health_score"] for r in churn.with_health_score(df).collect()]
    assert all(-1e-9 <= v <= 100 + 1e-9 for v in got)
    best = max(o * c for _, o, c, _ in values)
    want = [((1 - p) * 0.4 + o * c / (best + 0.01) * 0.3 + (n + 100) / 200 * 0.3) * 100 for p, o, c, n in values]
    assert sorted(got) == pytest.approx(sorted(want))
