"""The customer table: columns, features, domains and defaults."""

from __future__ import annotations

from pyspark.sql import types as T

# The customer table's columns, in table order.
CUSTOMER_SCHEMA = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("registration_date", T.StringType()),
        T.StructField("days_since_registration", T.LongType()),
        T.StructField("age", T.LongType()),
        T.StructField("gender", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("purchase_frequency", T.LongType()),
        T.StructField("avg_purchase_value", T.DoubleType()),
        T.StructField("total_spent", T.DoubleType()),
        T.StructField("last_purchase_days", T.LongType()),
        T.StructField("favorite_category", T.StringType()),
        T.StructField("preferred_channel", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("session_count", T.LongType()),
        T.StructField("avg_session_duration", T.LongType()),
        T.StructField("cart_abandonment_rate", T.DoubleType()),
        T.StructField("email_open_rate", T.DoubleType()),
        T.StructField("click_through_rate", T.DoubleType()),
        T.StructField("customer_lifetime_value", T.DoubleType()),
        T.StructField("churn_probability", T.DoubleType()),
        T.StructField("nps_score", T.LongType()),
        T.StructField("support_tickets", T.LongType()),
        T.StructField("returns_count", T.LongType()),
    ]
)

KEY = "customer_id"

# Text columns that are turned into numbers for the models.
CATEGORICALS = ["gender", "city", "favorite_category", "preferred_channel", "device_type"]

# The model features, in vector order.
FEATURES = [
    "days_since_registration",
    "age",
    "purchase_frequency",
    "avg_purchase_value",
    "total_spent",
    "last_purchase_days",
    "session_count",
    "avg_session_duration",
    "cart_abandonment_rate",
    "email_open_rate",
    "click_through_rate",
    "nps_score",
    "support_tickets",
    "returns_count",
    "gender_encoded",
    "city_encoded",
    "favorite_category_encoded",
    "preferred_channel_encoded",
    "device_type_encoded",
    "recency_score",
    "frequency_score",
    "monetary_score",
    "engagement_score",
    "email_engagement",
]

# Columns a scoring input must have; the rest are labels or unused by the models.
NOT_NEEDED_FOR_SCORING = ["segment", "registration_date", "customer_lifetime_value", "churn_probability"]
SCORING_COLUMNS = [c for c in CUSTOMER_SCHEMA.names if c not in NOT_NEEDED_FOR_SCORING]

# Text cells that mean "missing" in a CSV file (the documented pandas default set).
NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Allowed ranges (low, high); None means unbounded.
RANGES = {
    "days_since_registration": (0, None),
    "age": (18, 100),
    "purchase_frequency": (0, None),
    "avg_purchase_value": (0, None),
    "total_spent": (0, None),
    "last_purchase_days": (0, None),
    "session_count": (0, None),
    "avg_session_duration": (0, None),
    "cart_abandonment_rate": (0, 1),
    "email_open_rate": (0, 1),
    "click_through_rate": (0, 1),
    "nps_score": (-100, 100),
    "support_tickets": (0, None),
    "returns_count": (0, None),
}

# Allowed texts.
DOMAINS = {
    "gender": ["M", "F", "Other"],
    "city": ["Dhaka", "Chittagong", "Sylhet"],
    "favorite_category": ["Electronics", "Fashion"],
    "preferred_channel": ["Website", "Mobile App"],
    "device_type": ["Desktop", "Mobile", "Tablet"],
}

# Defaults for a customer whose value is not known.
DEFAULTS = {
    "days_since_registration": 365,
    "age": 30,
    "purchase_frequency": 5,
    "avg_purchase_value": 2000.0,
    "total_spent": 10000.0,
    "last_purchase_days": 30,
    "session_count": 20,
    "avg_session_duration": 300,
    "cart_abandonment_rate": 0.3,
    "email_open_rate": 0.4,
    "click_through_rate": 0.2,
    "nps_score": 50,
    "support_tickets": 2,
}

HIGH_VALUE_SEGMENT = "High-Value Loyal"
