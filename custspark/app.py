"""One object for the whole flow: load, keep, explore, train, score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from custspark.operators import explore, quality
from custspark.operators.encoding import fit_encoding
from custspark.operators.features import with_features
from custspark.operators.score import score
from custspark.operators.train import LARGE_FORESTS, CustomerModels, ForestParams, train
from custspark.sources import csv, tables


class CustomerAnalytics:
    """Customer analytics over one catalog table.

    DataFrames in and out; nothing but metrics, labels and models is held by
    the driver. ``train`` replaces the models of an earlier call.
    """

    def __init__(self, spark: SparkSession, table: str = tables.DEFAULT_TABLE) -> None:
        self.spark = spark
        self.table = table
        self.models: CustomerModels | None = None

    def read_csv(self, path: str | list[str], **options) -> DataFrame:
        return csv.read_customers_csv(self.spark, path, **options)

    def create_table(self) -> None:
        tables.create_table(self.spark, self.table)

    def save(self, df: DataFrame, check_key: bool = False) -> None:
        tables.save_table(df, self.table, check_key=check_key)

    def replace(self, df: DataFrame, path: str, **options) -> None:
        """Replace the table by a new version below ``path``; ``key`` makes it a primary key."""
        tables.replace_table(df, self.table, path, **options)

    def load(self) -> DataFrame:
        return tables.load_table(self.spark, self.table)

    def validate(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        return quality.split_valid(df)

    def features(self, df: DataFrame) -> DataFrame:
        """Customer columns, encoded categories and scores, with the trained encoding if there is one."""
        return with_features(df, self.models.encoding if self.models else fit_encoding(df))

    def train(self, df: DataFrame | None = None, params: ForestParams = LARGE_FORESTS, **options) -> DataFrame:
        """Fit on ``df`` or on the saved table; gives the metrics."""
        self.models, metrics = train(self.load() if df is None else df, params, **options)
        return metrics

    def score(self, df: DataFrame | None = None, **options) -> DataFrame:
        if self.models is None:
            raise RuntimeError("train or load models first")
        return score(self.load() if df is None else df, self.models, **options)

    def score_inputs(self, df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
        """Scores of new inputs, completed by the defaults and checked; and the rejected ones with their reasons."""
        valid, rejected = quality.split_valid(quality.fill_defaults(df))
        return self.score(valid, **options), rejected

    def save_models(self, path: str) -> None:
        if self.models is None:
            raise RuntimeError("train or load models first")
        self.models.save(path)

    def load_models(self, path: str) -> None:
        self.models = CustomerModels.load(path)

    def report(self, df: DataFrame | None = None, exact: bool = False, points: int | None = None) -> dict[str, DataFrame]:
        """The KPI cards and the data of every chart, each a lazy DataFrame.

        ``exact`` makes the means independent of the rows' layout; ``points`` bounds the scatter plot's per segment.
        """
        df = self.load() if df is None else df
        return {
            "kpi_summary": explore.kpi_summary(df, exact=exact),
            "preview": explore.preview(df),
            "segment_distribution": explore.segment_distribution(df),
            "clv_by_segment": explore.mean_by_segment(df, "customer_lifetime_value", "avg_lifetime_value", exact),
            "spend_histogram": explore.histogram(df, "total_spent"),
            "freq_vs_clv": explore.frequency_vs_lifetime_value(df, points),
            "churn_bands": explore.churn_bands(df),
            "churn_by_segment": explore.mean_by_segment(df, "churn_probability", "avg_churn_probability", exact),
        }
