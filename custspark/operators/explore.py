"""Descriptive aggregates: KPI cards and the data behind the charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custspark.functions.churn import is_at_risk, risk_band
from custspark.functions.missing import nan_to_null
from custspark.operators.exact_sums import exact_means
from custspark.operators.selection import sample_by_group
from custspark.operators.split import SEED
from custspark.schema import HIGH_VALUE_SEGMENT, KEY


def kpi_summary(df: DataFrame, total_columns: int | None = None, exact: bool = False) -> DataFrame:
    """All KPI cards in one pass over the data; NaN counts as missing.

    ``total_columns`` is the table's number of columns where ``df`` has only those that are read. With
    ``exact`` the means do not depend on the rows' layout, not even in the last bit, for a second pass.
    """
    columns = len(df.columns) if total_columns is None else total_columns
    if exact:
        return _exact_kpis(df, columns)
    return nan_to_null(df).agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.lit(columns).cast("bigint").alias("total_columns"),
        F.avg("customer_lifetime_value").alias("avg_lifetime_value"),
        (F.avg("churn_probability") * 100).alias("avg_churn_percent"),
        F.count_if(F.col("segment") == HIGH_VALUE_SEGMENT).alias("high_value_customers"),
        F.count_if(is_at_risk(F.col("churn_probability"))).alias("at_risk_customers"),
        F.avg("purchase_frequency").alias("avg_purchase_frequency"),
    )


def _exact_kpis(df: DataFrame, columns: int) -> DataFrame:
    names = {
        "customer_lifetime_value": "avg_lifetime_value",
        "churn_probability": "avg_churn",
        "purchase_frequency": "avg_purchase_frequency",
    }
    means = exact_means(df, names).select(F.struct(*names.values())).scalar()
    counts = kpi_summary(df.select("segment", "churn_probability", *[F.lit(None).cast("double").alias(c) for c in names if c != "churn_probability"]), columns)
    return counts.withColumn("means", means).withColumns(
        {
            "avg_lifetime_value": F.col("means.avg_lifetime_value"),
            "avg_churn_percent": F.col("means.avg_churn") * 100,
            "avg_purchase_frequency": F.col("means.avg_purchase_frequency"),
        }
    ).drop("means")


def high_value(df: DataFrame) -> DataFrame:
    return df.filter(F.col("segment") == HIGH_VALUE_SEGMENT)


def at_risk(df: DataFrame) -> DataFrame:
    return df.filter(is_at_risk(F.col("churn_probability")))


def row_count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def mean_by_segment(df: DataFrame, column: str, name: str, exact: bool = False) -> DataFrame:
    """Mean per segment in segment order; rows without a segment belong to none, NaN is missing.

    With ``exact`` a mean is the exact sum's, and so does not depend on the rows' layout.
    """
    if exact:
        present = df.select("segment", column).filter(F.col("segment").isNotNull())
        return exact_means(present, {column: name}, ["segment"]).orderBy("segment")
    return nan_to_null(df.select("segment", column)).filter(F.col("segment").isNotNull()).groupBy("segment").agg(F.avg(column).alias(name)).orderBy("segment")


def segment_distribution(df: DataFrame) -> DataFrame:
    """Customers and their share per segment, largest first.

    The total is the sum over the few segment rows, not another pass over the data.
    """
    counts = df.filter(F.col("segment").isNotNull()).groupBy("segment").agg(F.count(F.lit(1)).alias("n_customers"))
    total = counts.agg(F.sum("n_customers")).scalar()
    return counts.withColumn("share", F.col("n_customers") / total).orderBy(F.desc("n_customers"), "segment")


def churn_bands(df: DataFrame) -> DataFrame:
    """Customers per risk band, most frequent band first."""
    return (
        df.groupBy(risk_band(F.col("churn_probability")).alias("risk_band"))
        .agg(F.count(F.lit(1)).alias("n_customers"))
        .orderBy(F.desc("n_customers"), "risk_band")
    )


def frequency_vs_lifetime_value(df: DataFrame, size: int | None = None, seed: int = SEED) -> DataFrame:
    """The scatter plot's points: all of them, or ``size`` of each segment with their ``weight``."""
    points = df.select(KEY, "segment", "purchase_frequency", "customer_lifetime_value")
    return points if size is None else sample_by_group(points, size, "segment", seed=seed)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first customers by key: a distributed table has no file order to rely on."""
    return df.orderBy(KEY).limit(n)


def _round_width(rough: Column) -> Column:
    """The next of 2, 5 or 10 times a power of ten."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    lead = rough / power
    return F.when(lead <= 2, power * 2).when(lead <= 5, power * 5).otherwise(power * 10)


def histogram(df: DataFrame, column: str, max_bins: int = 50, round_width: bool = False) -> DataFrame:
    """Counts of ``column`` in bins of one width, empty ones included; NaN and infinite values are in none.

    By default ``max_bins`` equal bins between the least and the greatest value,
    the last one closed. With ``round_width`` the bins have a round width of at
    least a ``max_bins``-th of the range and start at a multiple of it, as
    charts draw them. The place of the bins is one scalar subquery, so the data
    is read twice and only bin counts are shuffled.
    """
    values = df.select(F.col(column).cast("double").alias("value")).filter(
        F.abs("value") < float("inf")  # neither missing nor NaN, which is above all numbers
    )
    spread = values.agg(F.min("value").alias("low"), F.max("value").alias("high")).withColumn(
        "rough", F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / float(max_bins))
    )
    width = F.coalesce(_round_width(F.col("rough")) if round_width else F.col("rough"), F.lit(1.0))
    start = F.floor(F.col("low") / F.col("width")) * F.col("width") if round_width else F.col("low")
    placed_at = spread.withColumn("width", width).withColumn("start", start)
    place = placed_at.select(F.struct("start", "width")).scalar()
    placed = values.withColumn("place", place)
    bin_no = F.floor((F.col("value") - F.col("place.start")) / F.col("place.width"))
    if not round_width:
        bin_no = F.least(bin_no, F.lit(max_bins - 1))
    counts = placed.groupBy(bin_no.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n_customers"))
    # A range is a few dozen rows, whatever the data.
    last = F.when(F.lit(round_width), F.floor((F.col("high") - F.col("start")) / F.col("width"))).otherwise(
        F.when(F.col("high") > F.col("low"), F.lit(max_bins - 1)).otherwise(F.lit(0))
    )
    bins = placed_at.filter("low is not null").select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("bin")
    )
    return (
        bins.join(counts, "bin", "left")
        .withColumn("place", place)
        .withColumn("n_customers", F.coalesce("n_customers", F.lit(0).cast("bigint")))
        .select(
            "bin",
            (F.col("place.start") + F.col("bin") * F.col("place.width")).alias("bin_start"),
            (F.col("place.start") + (F.col("bin") + 1) * F.col("place.width")).alias("bin_end"),
            "n_customers",
        )
        .orderBy("bin")
    )
