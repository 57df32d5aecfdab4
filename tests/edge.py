"""A hand-made customer table with the awkward cases."""

from custspark.schema import CUSTOMER_SCHEMA

NAN = float("nan")

BASE = {
    "customer_id": "c00",
    "segment": "Regular",
    "registration_date": "2024-01-01",
    "days_since_registration": 100,
    "age": 40,
    "gender": "F",
    "city": "Dhaka",
    "purchase_frequency": 5,
    "avg_purchase_value": 100.0,
    "total_spent": 500.0,
    "last_purchase_days": 9,
    "favorite_category": "Fashion",
    "preferred_channel": "Website",
    "device_type": "Mobile",
    "session_count": 10,
    "avg_session_duration": 300,
    "cart_abandonment_rate": 0.1,
    "email_open_rate": 0.5,
    "click_through_rate": 0.4,
    "customer_lifetime_value": 1000.0,
    "churn_probability": 0.2,
    "nps_score": 20,
    "support_tickets": 1,
    "returns_count": 0,
}

CASES = [
    {},
    {"customer_id": "c01", "churn_probability": 0.3},
    {"customer_id": "c02", "churn_probability": 0.30001},
    {"customer_id": "c03", "churn_probability": 0.5},
    {"customer_id": "c04", "churn_probability": 0.50001},
    {"customer_id": "c05", "churn_probability": None},
    {"customer_id": "c06", "churn_probability": NAN},
    {"customer_id": "c07", "segment": None},
    {"customer_id": "c08", "favorite_category": None, "gender": "X"},
    {"customer_id": "c09", "last_purchase_days": -1, "total_spent": -2.0, "purchase_frequency": -3},
    {"customer_id": "c10", "purchase_frequency": 0, "total_spent": 0.0},
    {"customer_id": "c11", "age": 17, "nps_score": 101, "cart_abandonment_rate": 1.2, "city": "Paris"},
    {"customer_id": "c11", "segment": "High-Value Loyal"},
]


def edge_rows(spark, cases=None):
    rows = [{**BASE, **case} for case in (CASES if cases is None else cases)]
    return spark.createDataFrame([tuple(r[c] for c in CUSTOMER_SCHEMA.names) for r in rows], CUSTOMER_SCHEMA)
