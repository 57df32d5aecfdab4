"""The 24-column customer table, derived from the star schema and the event log.

Each source is reduced to one row per customer with map-side aggregation
before the joins, so that a customer with a third of all orders or events
costs a few rows per task and not one long task. A query names the columns it
wants; branches that feed none of them are not planned at all.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custspark.schema import CUSTOMER_SCHEMA
from custspark.session import materialise

# Fixed values of the derived table.
REFERENCE_DATE = "2001-08-02"  # one day after the last order
SESSION_GAP_SECONDS = 21600
LOYAL_SPEND = 3500000
LAPSED_DAYS = 365
REGULAR_ORDERS = 10
CHURN_HORIZON_DAYS = 730
NEVER_ORDERED_DAYS = 9999

# Which derived columns need which branch.
FROM_ORDERS = {
    "segment",
    "registration_date",
    "days_since_registration",
    "purchase_frequency",
    "avg_purchase_value",
    "total_spent",
    "last_purchase_days",
    "churn_probability",
}
FROM_LINES = {"customer_lifetime_value", "returns_count", "favorite_category"}
FROM_SESSIONS = {"session_count", "avg_session_duration"}
FROM_EVENTS = FROM_SESSIONS | {
    "cart_abandonment_rate",
    "email_open_rate",
    "click_through_rate",
    "support_tickets",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _order_facts(orders: DataFrame) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return orders.groupBy(F.col("o_custkey").alias("o_ck")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
    )


def _line_facts(lines: DataFrame, orders: DataFrame, part: DataFrame | None) -> DataFrame:
    """Returns, lifetime value and, when ``part`` is given, the favourite category.

    One join of lines and orders serves all three. The category is the least
    ``(-quantity, category)`` pair, an aggregate, where a ranking window would
    have to sort every customer's rows in one task.
    """
    returned = F.col("l_returnflag") == "R"
    revenue = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    facts = lines.join(
        orders.select("o_orderkey", F.col("o_custkey").alias("l_ck")),
        F.col("l_orderkey") == F.col("o_orderkey"),
    ).select(
        "l_ck",
        "l_partkey",
        F.col("l_quantity").cast("decimal(12,2)").alias("quantity"),
        F.when(returned, 1).otherwise(0).cast("bigint").alias("returned"),
        F.when(~returned, revenue).alias("revenue"),
    )
    sums = [F.sum("returned").alias("n_returns"), F.sum("revenue").alias("lifetime_value")]
    if part is None:
        return facts.groupBy("l_ck").agg(*sums)
    types = part.select("p_partkey", F.col("p_type").alias("category"))
    per_type = (
        facts.join(types, F.col("l_partkey") == F.col("p_partkey"), "left")
        .groupBy("l_ck", "category")
        .agg(
            F.sum("returned").alias("returned"),
            F.sum("revenue").alias("revenue"),
            F.sum("quantity").alias("quantity"),
        )
    )
    ranked = F.struct((-F.col("quantity")).alias("rank"), "category")
    return per_type.groupBy("l_ck").agg(
        *sums, F.min(F.when(F.col("category").isNotNull(), ranked)).getField("category").alias("top_category")
    )


def _epoch_second(ts: Column) -> Column:
    """Whole seconds since 1970 from the wall clock, the same in every session time zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _event_facts(events: DataFrame, sessions: bool) -> DataFrame:
    """Event counts and, if asked for, sessions per user, without sorting a user's events.

    Events are grouped into time slots as long as the session gap. Inside a
    slot no pause can exceed the gap, so a slot is part of one session and its
    first and last second are all that counts. Sessions then follow from the
    pauses between neighbouring slots: a longer one starts a session, a
    shorter one adds to the time spent. The only ordered step runs over slots,
    and a user has at most four a day however many events there are.
    """
    kind = F.col("event_type")
    counts = {
        "n_errors": F.count_if(kind == "error"),
        "n_clicks": F.count_if(kind == "click"),
        "n_purchases": F.count_if(kind == "purchase"),
        "n_views": F.count_if(kind == "view"),
        "n_events": F.count(F.lit(1)),
    }
    rows = events.select(F.col("user_id").alias("e_ck"), "event_type", _epoch_second(F.col("ts")).alias("second"))
    if not sessions:
        return rows.groupBy("e_ck").agg(*[count.alias(name) for name, count in counts.items()])
    slots = (
        rows.withColumn("slot", F.floor(F.col("second") / SESSION_GAP_SECONDS))
        .groupBy("e_ck", "slot")
        .agg(
            F.min("second").alias("first"),
            F.max("second").alias("last"),
            *[count.alias(name) for name, count in counts.items()],
        )
    )
    before = F.lag("last").over(Window.partitionBy("e_ck").orderBy("slot"))
    pause = F.col("first") - F.col("before")
    return (
        slots.withColumn("before", before)
        .groupBy("e_ck")
        .agg(
            F.count_if(F.col("before").isNull() | (pause > SESSION_GAP_SECONDS)).alias("n_sessions"),
            F.sum(
                F.col("last") - F.col("first") + F.when(pause <= SESSION_GAP_SECONDS, pause).otherwise(0)
            ).alias("session_seconds"),
            *[F.sum(name).alias(name) for name in counts],
        )
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _definitions() -> dict[str, Column]:
    key = F.col("c_custkey")
    reference = F.lit(REFERENCE_DATE).cast("date")
    orders = F.coalesce("n_orders", F.lit(0)).cast("bigint")
    spent = F.coalesce(F.col("spent").cast("double"), F.lit(0.0))
    idle = F.coalesce(F.datediff(reference, "last_day"), F.lit(NEVER_ORDERED_DAYS)).cast("bigint")
    sessions = F.coalesce("n_sessions", F.lit(0)).cast("bigint")
    return {
        "customer_id": F.col("c_name"),
        "segment": F.when(spent >= LOYAL_SPEND, "High-Value Loyal")
        .when(idle > LAPSED_DAYS, "At-Risk")
        .when(orders >= REGULAR_ORDERS, "Regular")
        .otherwise("Occasional"),
        "registration_date": F.col("first_day").cast("string"),
        "days_since_registration": F.coalesce(F.datediff(reference, "first_day"), F.lit(0)).cast("bigint"),
        "age": (F.lit(18) + (key * 7) % 63).cast("bigint"),
        "gender": F.when(key % 3 == 0, "M").when(key % 3 == 1, "F").otherwise("Other"),
        "city": F.col("n_name"),
        "purchase_frequency": orders,
        "avg_purchase_value": F.when(orders > 0, spent / orders).otherwise(F.lit(0.0)),
        "total_spent": spent,
        "last_purchase_days": idle,
        "favorite_category": F.col("top_category"),
        "preferred_channel": F.when(key % 2 == 0, "Website").otherwise("Mobile App"),
        "device_type": F.when(key % 5 < 2, "Mobile").when(key % 5 < 4, "Desktop").otherwise("Tablet"),
        "session_count": sessions,
        "avg_session_duration": F.coalesce(F.floor(F.col("session_seconds") / F.col("n_sessions")), F.lit(0)).cast(
            "bigint"
        ),
        "cart_abandonment_rate": _ratio(F.col("n_clicks"), F.col("n_clicks") + F.col("n_purchases")),
        "email_open_rate": _ratio(F.col("n_views"), F.col("n_events")),
        "click_through_rate": _ratio(F.col("n_clicks"), F.col("n_clicks") + F.col("n_views")),
        "customer_lifetime_value": F.coalesce(F.col("lifetime_value").cast("double"), F.lit(0.0)),
        "churn_probability": F.least(F.lit(1.0), idle.cast("double") / CHURN_HORIZON_DAYS),
        "nps_score": ((key * 37) % 201 - 100).cast("bigint"),
        "support_tickets": F.coalesce("n_errors", F.lit(0)).cast("bigint"),
        "returns_count": F.coalesce("n_returns", F.lit(0)).cast("bigint"),
    }


def customers(
    spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None, first: int | None = None
) -> DataFrame:
    """The customer table, or the named columns of it in table order.

    ``first`` asks for the first customers by key alone: their keys are sent to
    the facts, which are then not aggregated for all others.
    """
    wanted = set(CUSTOMER_SCHEMA.names if columns is None else columns)
    names = [c for c in CUSTOMER_SCHEMA.names if c in wanted]
    out = _table(spark, sf_dir, "customer")
    if "city" in wanted:
        nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        out = out.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    orders, events = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "events")
    if first is not None:
        out = out.orderBy("c_name").limit(first)
        # Written, so that their sizes are known when the joins are planned: no large table is
        # shuffled for a few customers, and nothing is broadcast that is not small.
        keys = materialise(out.select(F.col("c_custkey").alias("key")), "first-keys")
        orders = materialise(orders.join(keys, F.col("o_custkey") == F.col("key"), "left_semi"), "first-orders")
        events = events.join(keys, F.col("user_id") == F.col("key"), "left_semi")
    if wanted & FROM_ORDERS:
        out = out.join(_order_facts(orders), F.col("c_custkey") == F.col("o_ck"), "left")
    if wanted & FROM_LINES:
        part = _table(spark, sf_dir, "part") if "favorite_category" in wanted else None
        facts = _line_facts(_table(spark, sf_dir, "lineitem"), orders, part)
        out = out.join(facts, F.col("c_custkey") == F.col("l_ck"), "left")
    if wanted & FROM_EVENTS:
        facts = _event_facts(events, bool(wanted & FROM_SESSIONS))
        out = out.join(facts, F.col("c_custkey") == F.col("e_ck"), "left")
    definitions = _definitions()
    return out.select(*[definitions[c].alias(c) for c in names])
