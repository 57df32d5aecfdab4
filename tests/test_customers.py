"""The derived customer table: sessions against brute force, skew, and the shape of the plan."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from custspark.plans.customers import _event_facts, _line_facts, customers
from custspark.schema import CUSTOMER_SCHEMA

GAP = 21600
START = datetime(2024, 3, 30, 22, 0, 0)


def brute_force(seconds):
    """(sessions, floor of the mean session length)"""
    lengths, first, last = [], None, None
    for s in sorted(seconds):
        if last is None or s - last > GAP:
            if first is not None:
                lengths.append(last - first)
            first = s
        last = s
    lengths.append(last - first)
    return len(lengths), sum(lengths) // len(lengths)


def sessions_of(spark, events):
    rows = [(u, START + timedelta(seconds=s, microseconds=m), k) for u, s, m, k in events]
    df = spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz, event_type string")
    return {r["e_ck"]: r for r in _event_facts(df, True).collect()}


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.integers(1, 3),
            st.one_of(st.integers(0, 400000), st.integers(0, 20).map(lambda i: i * GAP)),
            st.integers(0, 999999),
            st.sampled_from(["error", "click", "purchase", "view", "signup"]),
        ),
        min_size=1,
        max_size=60,
    )
)
def test_sessions_equal_brute_force(spark, events):
    got = sessions_of(spark, events)
    assert set(got) == {e[0] for e in events}
    for user, row in got.items():
        mine = [e for e in events if e[0] == user]
        assert (row["n_sessions"], row["session_seconds"] // row["n_sessions"]) == brute_force([e[1] for e in mine])
        assert row["n_events"] == len(mine)
        assert row["n_errors"] == sum(e[3] == "error" for e in mine)
        assert row["n_views"] == sum(e[3] == "view" for e in mine)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Europe/Berlin"])
def test_sessions_do_not_depend_on_the_time_zone(spark, zone):
    """The wall clock of the log has no hour that is skipped or repeated."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = sessions_of(spark, [(1, h * 3600, 0, "view") for h in (0, 3, 5, 12)])[1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert (row["n_sessions"], row["session_seconds"]) == (2, 5 * 3600)


def test_favourite_category_ties_and_hot_customer(spark):
    """One customer with a third of all lines; a tie goes to the first category by name."""
    lines = spark.range(9000).select(
        F.col("id").alias("l_orderkey"),
        (F.col("id") % 4).alias("l_partkey"),
        F.lit(1.0).alias("l_quantity"),
        F.lit(10.0).alias("l_extendedprice"),
        F.lit(0.1).alias("l_discount"),
        F.when(F.col("id") % 10 == 0, "R").otherwise("N").alias("l_returnflag"),
    )
    orders = spark.range(9000).select(
        F.col("id").alias("o_orderkey"), F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("o_custkey")
    )
    part = spark.createDataFrame([(0, "b"), (1, "a"), (2, None)], "p_partkey bigint, p_type string")
    facts = {r["l_ck"]: r for r in _line_facts(lines, orders, part).collect()}
    hot = facts[0]
    assert (hot["n_returns"], float(hot["lifetime_value"]), hot["top_category"]) == (300, 2700 * 9.0, "a")
    assert facts[3003]["top_category"] is None and len(facts) == 6001
    plain = {r["l_ck"]: r for r in _line_facts(lines, orders, None).collect()}
    for key, row in facts.items():
        assert (plain[key]["n_returns"], plain[key]["lifetime_value"]) == (row["n_returns"], row["lifetime_value"])


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_only_needed_branches_are_planned(spark, small_dir):
    plan = plan_of(customers(spark, small_dir, ["segment"]))
    assert "orders.parquet" in plan and "lineitem.parquet" not in plan and "events.parquet" not in plan
    plan = plan_of(customers(spark, small_dir, ["returns_count"]))
    assert "lineitem.parquet" in plan and "part.parquet" not in plan
    assert "l_quantity" not in plan.split("Physical Plan")[1]


def test_first_customers_are_rows_of_the_whole_table(spark, small_dir):
    few = {tuple(r) for r in customers(spark, small_dir, first=12).collect()}
    every = sorted(tuple(r) for r in customers(spark, small_dir).collect())
    assert few == set(every[:12])
    plan = customers(spark, small_dir, first=10_001)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


def test_schema_and_column_order(spark, small_dir):
    df = customers(spark, small_dir)
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in CUSTOMER_SCHEMA]
    assert customers(spark, small_dir, ["city", "segment"]).columns == ["segment", "city"]
