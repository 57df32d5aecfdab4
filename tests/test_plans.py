"""Plans over a stored customer table: what is read, pushed down and shuffled."""

import re

import pytest

from custspark.functions.churn import with_health_score
from custspark.functions.scores import with_engagement
from custspark.operators import explore, quality
from custspark.operators.encoding import fit_encoding
from custspark.operators.features import with_features
from custspark.operators.split import split
from custspark.sources.tables import key_report


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def columns_read(plan):
    return [sorted(re.findall(r"(\w+)#", scan)) for scan in re.findall(r"FileScan parquet \[([^\]]*)\]", plan)]


def test_filters_reach_the_scan(customer_rows):
    assert "GreaterThan(churn_probability,0.5)" in physical(explore.at_risk(customer_rows))
    assert "EqualTo(segment,High-Value Loyal)" in physical(explore.high_value(customer_rows))
    assert "IsNotNull(segment)" in physical(explore.mean_by_segment(customer_rows, "age", "m"))


def test_only_needed_columns_are_read(customer_rows):
    kpis = physical(explore.kpi_summary(customer_rows))
    assert columns_read(kpis) == [["churn_probability", "customer_lifetime_value", "purchase_frequency", "segment"]]
    assert columns_read(physical(explore.churn_bands(customer_rows))) == [["churn_probability"]]
    histogram = explore.histogram(customer_rows, "total_spent")
    histogram.collect()
    assert all(columns == ["total_spent"] for columns in columns_read(physical(histogram)))
    assert "ReusedSubquery" in physical(histogram)
    health = physical(with_health_score(with_engagement(customer_rows)).select("customer_health_score"))
    mail = ["click_through_rate", "email_open_rate"]
    assert sorted(columns_read(health)) == sorted([["churn_probability", *mail, "nps_score"], mail])


@pytest.mark.parametrize(
    ("name", "shuffles"),
    [("kpi_summary", 1), ("features", 0), ("violations", 0), ("defaults", 0), ("split", 0), ("keys", 2), ("bands", 2)],
)
def test_number_of_shuffles(customer_rows, name, shuffles):
    df = {
        "kpi_summary": lambda: explore.kpi_summary(customer_rows),
        "features": lambda: with_features(customer_rows, fit_encoding(customer_rows)),
        "violations": lambda: quality.with_violations(customer_rows),
        "defaults": lambda: quality.fill_defaults(customer_rows),
        "split": lambda: split(customer_rows)[0],
        "keys": lambda: key_report(customer_rows),
        "bands": lambda: explore.churn_bands(customer_rows),
    }[name]()
    plan = physical(df)
    assert plan.count("Exchange ") == shuffles
    for word in ("Python", "CartesianProduct", "NestedLoop", "Window"):
        assert word not in plan


def test_preview_sorts_no_more_than_its_rows(customer_rows):
    plan = physical(explore.preview(customer_rows))
    assert "TakeOrderedAndProject(limit=10" in plan and "Exchange" not in plan


def test_share_does_not_count_twice(customer_rows):
    df = explore.segment_distribution(customer_rows)
    df.collect()
    final = physical(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in physical(df) or final.count("FileScan") == 1
