"""The registered queries. Each runs over the whole customer table of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custspark.functions.churn import churn_label, health_score, retention_priority, with_health_score
from custspark.functions.scores import email_engagement, with_engagement, with_rfm_scores
from custspark.operators import encoding, evaluate, explore, quality, scaling
from custspark.operators.features import assemble, project_features, with_features
from custspark.operators.score import score, spread
from custspark.operators.selection import is_exact_train, test_cut
from custspark.operators.split import is_train
from custspark.operators.train import SMALL_FORESTS, ForestParams, train
from custspark.plans.customers import customers
from custspark.schema import CATEGORICALS, CUSTOMER_SCHEMA, DEFAULTS, FEATURES, KEY
from custspark.session import materialise, shared_folder
from custspark.sources.csv import preview_csv, read_customers_csv, write_customers_csv
from custspark.sources.tables import create_table, duplicate_keys, key_report, load_table, replace_table, save_table

Query = Callable[[SparkSession, str], DataFrame]

RFM_INPUTS = ["last_purchase_days", "purchase_frequency", "total_spent"]
WHOLE_NUMBERS = ["age", "session_count", "avg_session_duration"]
KPI_INPUTS = ["segment", "customer_lifetime_value", "churn_probability", "purchase_frequency"]
ENGAGEMENT_INPUTS = ["session_count", "avg_session_duration", "email_open_rate", "click_through_rate"]


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def customer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir)


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "csv")
    write_customers_csv(customers(spark, sf_dir), path)
    return read_customers_csv(spark, path)


def scan_csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with line breaks, quotes and commas in most records."""
    path = shared_folder(spark, "csv")
    rows = customers(spark, sf_dir)
    broken = _by_age(
        {0: F.concat("city", F.lit('\n"'), "gender", F.lit('",\n'), "segment"), 1: F.concat(F.lit('a\n,"\n"'), "city")}, F.col("city")
    )
    channel = _by_age({1: F.concat("preferred_channel", F.lit('"\n\nx')), 2: F.lit('5" "')}, F.col("preferred_channel"))
    write_customers_csv(rows.withColumns({"city": broken, "preferred_channel": channel}), path)
    return read_customers_csv(spark, path)


def table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"customers_{uuid.uuid4().hex}"
    path = shared_folder(spark, "table")
    create_table(spark, name, path)
    save_table(customers(spark, sf_dir), name, path)
    rows = load_table(spark, name)
    spark.sql(f"DROP TABLE {name}")  # the name goes; the rows stay in the folder
    return rows


def key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_report(customers(spark, sf_dir, [KEY]))


def feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(customers(spark, sf_dir), "customers")
    features = project_features(with_features(rows, encoding.fit_encoding(rows)))
    return _rounded(
        features,
        9,
        "recency_score",
        "frequency_score",
        "monetary_score",
        "engagement_score",
        "email_engagement",
    )


def kpi_high_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.row_count(explore.high_value(customers(spark, sf_dir, ["segment"])), "high_value_customers")


def kpi_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.row_count(explore.at_risk(customers(spark, sf_dir, ["churn_probability"])), "at_risk_customers")


def churn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir, [KEY, "churn_probability"])
    return rows.select(KEY, churn_label(F.col("churn_probability")).alias("churn_label"))


def freq_vs_clv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.frequency_vs_lifetime_value(
        customers(spark, sf_dir, [KEY, "segment", "purchase_frequency", "customer_lifetime_value"])
    )


def rfm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_rfm_scores(customers(spark, sf_dir, [KEY, *RFM_INPUTS])).drop(*RFM_INPUTS)
    return _rounded(rows, 9, "recency_score", "frequency_score", "monetary_score")


def engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_engagement(customers(spark, sf_dir, [KEY, *ENGAGEMENT_INPUTS])).drop(*ENGAGEMENT_INPUTS)
    return _rounded(rows, 9, "engagement_score", "email_engagement")


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir, [KEY, "churn_probability"])
    return rows.select(KEY, retention_priority(F.col("churn_probability")).alias("retention_priority"))


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [KEY, "churn_probability", "nps_score", "email_open_rate", "click_through_rate"]
    mail = email_engagement(F.col("email_open_rate"), F.col("click_through_rate"))
    rows = with_health_score(customers(spark, sf_dir, columns).withColumn("email_engagement", mail))
    return _rounded(rows.select(KEY, "customer_health_score"), 6, "customer_health_score")


def health_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health score on a fixed scale, independent of the batch."""
    columns = [KEY, "churn_probability", "nps_score", "email_open_rate", "click_through_rate"]
    mail = email_engagement(F.col("email_open_rate"), F.col("click_through_rate"))
    rows = customers(spark, sf_dir, columns).withColumn("email_engagement", mail)
    return _rounded(with_health_score(rows, reference_max=0.5).select(KEY, "customer_health_score"), 6, "customer_health_score")


def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        explore.kpi_summary(customers(spark, sf_dir, KPI_INPUTS), len(CUSTOMER_SCHEMA.names)),
        4,
        "avg_lifetime_value",
        "avg_churn_percent",
        "avg_purchase_frequency",
    )


def clv_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir, ["segment", "customer_lifetime_value"])
    return _rounded(
        explore.mean_by_segment(rows, "customer_lifetime_value", "avg_lifetime_value"), 4, "avg_lifetime_value"
    )


def churn_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir, ["segment", "churn_probability"])
    return _rounded(
        explore.mean_by_segment(rows, "churn_probability", "avg_churn_probability"), 9, "avg_churn_probability"
    )


def segment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(explore.segment_distribution(customers(spark, sf_dir, ["segment"])), 9, "share")


def churn_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.churn_bands(customers(spark, sf_dir, ["churn_probability"]))


def spend_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir, ["total_spent"])
    return _rounded(explore.histogram(rows, "total_spent"), 4, "bin_start", "bin_end")


def spend_histogram_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir, ["total_spent"])
    return _rounded(explore.histogram(rows, "total_spent", round_width=True), 4, "bin_start", "bin_end")


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.preview(customers(spark, sf_dir, first=10), 10)


def _encoded(df: DataFrame, fitted: encoding.CategoryEncoding) -> DataFrame:
    return fitted.transform(df).select(KEY, *[f"{c}_encoded" for c in CATEGORICALS])


def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(customers(spark, sf_dir, [KEY, *CATEGORICALS]), "categories")
    return _encoded(rows, encoding.fit_encoding(rows))


def label_encode_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the customers of some cities, applied to those of all."""
    rows = materialise(customers(spark, sf_dir, [KEY, *CATEGORICALS]), "categories")
    return _encoded(rows, encoding.fit_encoding(rows.filter(F.col("city") < "NATION_5")))


def label_encode_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoding for columns with too many labels for one place: the customer key's rank."""
    rows = materialise(customers(spark, sf_dir, [KEY]), "keys")
    return encoding.fit_encoding(rows, [KEY], max_in_memory=0).transform(rows)


def segment_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(customers(spark, sf_dir, [KEY, "segment"]), "segments")
    encoded = encoding.encode_segment(rows, encoding.fit_segment_labels(rows))
    return encoded.select(KEY, F.col("segment_label").cast("bigint").alias("segment_label"))


def segment_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(customers(spark, sf_dir, [KEY, "segment"]), "segments")
    labels = encoding.fit_segment_labels(rows)
    encoded = encoding.encode_segment(rows, labels).drop("segment")
    return encoding.decode_segment(encoded, labels, "segment_label", "segment").select(KEY, "segment")


def segment_labels_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More classes than the driver may hold, there and back: every customer's key is a class of its own."""
    rows = materialise(customers(spark, sf_dir, [KEY]), "segments")
    labels = encoding.fit_segment_labels(rows, KEY, max_in_memory=0)
    encoded = encoding.encode_segment(rows, labels, KEY).withColumnRenamed(KEY, "original")
    decoded = encoding.decode_segment(encoded, labels, "segment_label", KEY)
    return decoded.select(KEY, F.col("segment_label").cast("bigint").alias("segment_label"), "original")


def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(customers(spark, sf_dir), "customers")
    features = with_features(rows, encoding.fit_encoding(rows)).select(KEY, *FEATURES)
    scaled = scaling.fit_standardizer(features, FEATURES).transform(features)
    return _rounded(scaled, 6, *FEATURES)


def assembled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature vectors, one row per entry."""
    rows = materialise(customers(spark, sf_dir), "customers")
    vectors = assemble(with_features(rows, encoding.fit_encoding(rows)))
    entries = vectors.select(KEY, F.posexplode(vector_to_array("features")).alias("position", "value"))
    return _rounded(entries, 6, "value")


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir, [KEY]).withColumn("is_train", is_train())


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir, [KEY, "segment"])
    return rows.groupBy(is_train().alias("is_train"), "segment").agg(F.count(F.lit(1)).alias("n_customers"))


def train_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, metrics = train(materialise(customers(spark, sf_dir), "customers"))
    return metrics


def train_metrics_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smaller of the two forest sizes."""
    _, metrics = train(materialise(customers(spark, sf_dir), "customers"), SMALL_FORESTS)
    return metrics


def score_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(customers(spark, sf_dir), "customers")
    models, _ = train(rows)
    return score(spread(rows), models)


def eval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of two rules of thumb, so that the value can be checked."""
    rows = customers(spark, sf_dir, ["segment", "churn_probability", "purchase_frequency", "total_spent"])
    lapsed = (F.col("purchase_frequency") < 9).cast("int")
    loyal = (F.col("segment") == "High-Value Loyal").cast("int")
    big = (F.col("total_spent") > 3000000).cast("int")
    metrics = {
        ("churn", "accuracy"): evaluate.accuracy(churn_label(F.col("churn_probability")), lapsed),
        ("segment", "accuracy"): evaluate.accuracy(loyal, big),
    }
    return _rounded(evaluate.as_rows(rows, metrics), 9, "value")


def eval_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 and mean absolute error of two rules of thumb."""
    rows = customers(spark, sf_dir, ["customer_lifetime_value", "total_spent", "purchase_frequency"])
    clv = F.col("customer_lifetime_value"), F.col("total_spent") * F.lit(0.4)
    frequency = F.col("purchase_frequency"), F.col("total_spent") / F.lit(250000.0)
    metrics: dict[tuple[str, str], Column] = {
        ("clv", "r2"): evaluate.r2(*clv),
        ("clv", "mae"): evaluate.mean_absolute_error(*clv),
        ("frequency", "r2"): evaluate.r2(*frequency),
        ("frequency", "mae"): evaluate.mean_absolute_error(*frequency),
    }
    return _rounded(evaluate.as_rows(rows, metrics), 6, "value")


def validate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = quality.with_violations(customers(spark, sf_dir))
    return checked.select(KEY, F.array_join("violations", ",").alias("violations"), "is_valid")


def fill_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without tracked events get the default engagement."""
    unknown = [*ENGAGEMENT_INPUTS, "cart_abandonment_rate", "support_tickets"]
    rows = customers(spark, sf_dir, [KEY, *DEFAULTS])
    known = F.col("session_count") > 0
    return quality.fill_defaults(rows.withColumns({c: F.when(known, F.col(c)) for c in unknown}))


def scan_csv_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-number columns with fractions, kept."""
    path = shared_folder(spark, "csv")
    rows = customers(spark, sf_dir, [KEY, *WHOLE_NUMBERS])
    halves = rows.withColumn("avg_session_duration", F.col("avg_session_duration") + F.lit(0.5))
    write_customers_csv(halves, path)
    required = T.StructType([f for f in CUSTOMER_SCHEMA if f.name in rows.columns])
    return read_customers_csv(spark, path, required, fractions="keep")


def _by_age(cases: dict[int, Column | None], usual: Column) -> Column:
    """A value by age modulo five, to set gaps and edge values by a rule."""
    picked = F.when(F.lit(False), usual)
    for rest, value in cases.items():
        picked = picked.when(F.col("age") % 5 == rest, F.lit(None) if value is None else value)
    return picked.otherwise(usual)


def _with_gaps(rows: DataFrame) -> DataFrame:
    """Churn and lifetime value with NaN, NULL and threshold values."""
    nan = F.lit(float("nan"))
    churn = _by_age({0: nan, 1: None, 2: F.lit(0.3), 3: F.lit(0.5)}, F.col("churn_probability"))
    clv = _by_age({1: nan, 2: None}, F.col("customer_lifetime_value"))
    return rows.withColumns({"churn_probability": churn, "customer_lifetime_value": clv})


def kpi_summary_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_gaps(customers(spark, sf_dir, [*KPI_INPUTS, "age"])).drop("age")
    summary = explore.kpi_summary(rows, len(CUSTOMER_SCHEMA.names))
    return _rounded(summary, 4, "avg_lifetime_value", "avg_churn_percent", "avg_purchase_frequency")


def means_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_gaps(customers(spark, sf_dir, [*KPI_INPUTS, "age"]))
    churn = explore.mean_by_segment(rows, "churn_probability", "avg_churn_probability")
    clv = explore.mean_by_segment(rows, "customer_lifetime_value", "avg_lifetime_value")
    return _rounded(_rounded(churn.join(clv, "segment"), 9, "avg_churn_probability"), 4, "avg_lifetime_value")


SOME_VALID = {"gender": ["M", "F"]}


def _odd_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nan = F.lit(float("nan"))
    rate = _by_age({0: nan, 1: None, 2: F.lit(1.2), 3: F.lit(1.0)}, F.col("email_open_rate"))
    return customers(spark, sf_dir).withColumn("email_open_rate", rate)


def validate_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = quality.with_violations(_odd_rates(spark, sf_dir), domains=SOME_VALID)
    return checked.select(KEY, F.array_join("violations", ",").alias("violations"), "is_valid")


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = quality.split_valid(_odd_rates(spark, sf_dir), domains=SOME_VALID)
    return rejected.select(KEY, F.array_join("violations", ",").alias("violations"))


def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customers(spark, sf_dir, [KEY, "age", *RFM_INPUTS]).withColumns(
        {
            "last_purchase_days": _by_age({0: F.lit(-1).cast("bigint"), 1: None}, F.col("last_purchase_days")),
            "total_spent": _by_age({0: F.lit(-2.0), 2: F.lit(-1.0)}, F.col("total_spent")),
        }
    )
    flagged = quality.with_quality_flags(rows)
    return flagged.select(KEY, F.array_join("score_flags", ",").alias("score_flags"))


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of some ages are there twice."""
    rows = customers(spark, sf_dir, [KEY, "age"])
    return duplicate_keys(rows.union(rows.filter(F.col("age") % 5 == 0)))


def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split with exactly a fifth of the rows, rounded up, on the test side."""
    rows = materialise(customers(spark, sf_dir, [KEY]), "keys")
    return rows.withColumn("is_train", is_exact_train(test_cut(rows)))


def freq_vs_clv_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred points of each segment, with the customers each stands for."""
    columns = [KEY, "segment", "purchase_frequency", "customer_lifetime_value"]
    return explore.frequency_vs_lifetime_value(customers(spark, sf_dir, columns), size=100)


def kpi_summary_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(customers(spark, sf_dir, KPI_INPUTS), "kpi")
    return explore.kpi_summary(rows, len(CUSTOMER_SCHEMA.names), exact=True)


def means_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by segment to the last bit."""
    rows = materialise(customers(spark, sf_dir, KPI_INPUTS), "means")
    churn = explore.mean_by_segment(rows, "churn_probability", "avg_churn_probability", exact=True)
    return churn.join(explore.mean_by_segment(rows, "customer_lifetime_value", "avg_lifetime_value", exact=True), "segment")


def scan_csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns beyond the schema, with the types of all their cells."""
    path = shared_folder(spark, "csv")
    rows = customers(spark, sf_dir, [KEY, "age"]).withColumns(
        {
            "a_whole": F.col("age") * 3,
            "a_fraction": F.col("age") / F.lit(4.0),
            "a_flag": F.col("age") % 2 == 0,
            "a_gap": F.when(F.col("age") % 5 != 0, F.col("age")),
            "a_late": F.when(F.col("age") == 74, F.lit("seventy-four")).otherwise(F.col("age").cast("string")),
            "a_nothing": F.lit(None).cast("string"),
        }
    )
    write_customers_csv(rows, path)
    required = T.StructType([f for f in CUSTOMER_SCHEMA if f.name in (KEY, "age")])
    return read_customers_csv(spark, path, required, further="infer")


def preview_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a folder of CSV files, of which only the first are opened."""
    path = shared_folder(spark, "csv")
    write_customers_csv(customers(spark, sf_dir).orderBy(F.desc(KEY)), path)
    return preview_csv(spark, path, 10)


def _replaced(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A table with a primary key that was replaced by rows made from itself."""
    name, path = f"customers_{uuid.uuid4().hex}", shared_folder(spark, "table")
    replace_table(customers(spark, sf_dir), name, path, key=KEY, buckets=8)
    replace_table(load_table(spark, name).filter("age > 30"), name, path, key=KEY, buckets=8)
    return name, path


def table_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, _ = _replaced(spark, sf_dir)
    rows = load_table(spark, name)
    spark.sql(f"DROP TABLE {name}")  # the name goes; the rows stay in the folder
    return rows


def key_check_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key check on a table that is bucketed by key: no shuffle by key."""
    name, _ = _replaced(spark, sf_dir)
    report = key_report(load_table(spark, name))
    spark.sql(f"DROP TABLE {name}")
    return report


# One tree a model, which sees every row and feature, with a bin for each value: SQL can grow the same one.
PLAIN_TREES = ForestParams(
    trees=1, depth=3, feature_subset="all", regression_subset="all", max_bins=16_384, bootstrap=False
)


def tree_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six metrics of ``PLAIN_TREES``, by value.

    Equal to SQL as long as no feature has more distinct values than the trees have bins.
    """
    _, metrics = train(materialise(customers(spark, sf_dir), "customers"), PLAIN_TREES)
    rounded = F.when(F.col("metric") == "mae", F.round("value", 2)).otherwise(F.round("value", 6))
    return metrics.select("model", "metric", rounded.alias("value"))


def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of every customer by ``PLAIN_TREES``, by value; see ``tree_metrics``."""
    rows = materialise(customers(spark, sf_dir), "customers")
    scored = score(rows, train(rows, PLAIN_TREES)[0])
    digits = {"churn_probability": 9, "predicted_clv": 2, "predicted_frequency": 6, "customer_health_score": 6}
    return scored.withColumns({c: F.round(c, n) for c, n in digits.items()})


def score_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each customer's scores agree with each other, with the formulas and with the labels' range; for ``SMALL_FORESTS``."""
    rows = materialise(customers(spark, sf_dir), "customers")
    models, _ = train(rows, SMALL_FORESTS)
    inputs = ["email_open_rate", "click_through_rate", "nps_score"]
    best = rows.agg(F.max(F.col("email_open_rate") * F.col("click_through_rate"))).scalar()
    low, high = (rows.agg(f("customer_lifetime_value")).scalar() for f in (F.min, F.max))
    least, most = (rows.agg(f("purchase_frequency")).scalar() for f in (F.min, F.max))
    p, mail = F.col("churn_probability"), F.col("email_open_rate") * F.col("click_through_rate")
    scored = score(rows, models).join(rows.select(KEY, *inputs), KEY)
    return scored.select(
        KEY,
        p.between(0, 1).alias("probability_fits"),
        (F.col("will_churn") == (p > 0.5).cast("int")).alias("class_fits"),
        (F.col("retention_priority") == retention_priority(p)).alias("priority_fits"),
        (F.abs(F.col("customer_health_score") - health_score(p, mail, best, F.col("nps_score"))) < 1e-9).alias("health_fits"),
        F.col("predicted_clv").between(low, high).alias("clv_fits"),
        F.col("predicted_frequency").between(least, most).alias("frequency_fits"),
        F.col("predicted_segment").isin(models.segment_labels).alias("segment_fits"),
    )


def train_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each model beats the prediction that knows the labels' distribution alone; for ``SMALL_FORESTS``."""
    rows = materialise(customers(spark, sf_dir), "customers")
    _, metrics = train(rows, SMALL_FORESTS)
    test = rows.filter(~is_train())
    share = F.greatest(F.avg((F.col("churn_probability") > 0.5).cast("int")), F.avg((F.col("churn_probability") <= 0.5).cast("int")))
    churn = test.agg(share).scalar()
    segment = test.groupBy("segment").count().agg(F.max("count") / F.sum("count")).scalar()
    clv, frequency = (
        test.agg(F.avg(F.abs(F.col(c) - rows.agg(F.avg(c)).scalar()))).scalar()
        for c in ("customer_lifetime_value", "purchase_frequency")
    )
    floor = (
        F.when(F.col("model") == "churn", churn)
        .when(F.col("model") == "segment", segment)
        .when(F.col("metric") == "r2", F.lit(0.0))
        .when(F.col("model") == "clv", clv)
        .otherwise(frequency)
    )
    better = F.when(F.col("metric") == "mae", F.col("value") < floor).otherwise(F.col("value") > floor)
    return metrics.select("model", "metric", better.alias("beats_trivial"))


QUERIES: dict[str, Query] = {
    "customer_table": customer_table,
    "scan_csv": scan_csv,
    "scan_csv_quoted": scan_csv_quoted,
    "table_roundtrip": table_roundtrip,
    "key_check": key_check,
    "feature_projection": feature_projection,
    "kpi_high_value": kpi_high_value,
    "kpi_at_risk": kpi_at_risk,
    "churn_label": churn_labels,
    "freq_vs_clv": freq_vs_clv,
    "rfm_scores": rfm_scores,
    "engagement": engagement,
    "retention_priority": retention,
    "health_score": health,
    "kpi_summary": kpi_summary,
    "clv_by_segment": clv_by_segment,
    "churn_by_segment": churn_by_segment,
    "segment_distribution": segment_distribution,
    "churn_bands": churn_bands,
    "spend_histogram": spend_histogram,
    "spend_histogram_round": spend_histogram_round,
    "preview": preview,
    "label_encode": label_encode,
    "label_encode_unseen": label_encode_unseen,
    "label_encode_large": label_encode_large,
    "segment_encode": segment_encode,
    "segment_decode": segment_decode,
    "segment_labels_large": segment_labels_large,
    "standardize": standardize,
    "assembled_features": assembled_features,
    "split_rows": split_rows,
    "split_counts": split_counts,
    "train_metrics": train_metrics,
    "train_metrics_small": train_metrics_small,
    "score_customers": score_customers,
    "eval_accuracy": eval_accuracy,
    "eval_regression": eval_regression,
    "validate_inputs": validate_inputs,
    "fill_defaults": fill_defaults,
    "health_score_fixed_max": health_fixed,
    "scan_csv_fractions": scan_csv_fractions,
    "kpi_summary_missing": kpi_summary_missing,
    "means_missing": means_missing,
    "validate_missing": validate_missing,
    "rejected_rows": rejected_rows,
    "quality_flags": quality_flags,
    "duplicate_keys": repeated_keys,
    "split_exact": split_exact,
    "freq_vs_clv_sample": freq_vs_clv_sample,
    "kpi_summary_exact": kpi_summary_exact,
    "means_exact": means_exact,
    "scan_csv_inferred": scan_csv_inferred,
    "preview_file_order": preview_file_order,
    "table_replaced": table_replaced,
    "key_check_bucketed": key_check_bucketed,
    "tree_metrics": tree_metrics,
    "tree_scores": tree_scores,
    "score_contract": score_contract,
    "train_floors": train_floors,
}
