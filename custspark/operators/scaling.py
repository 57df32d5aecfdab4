"""Standardisation with the population standard deviation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Standardizer:
    """Fitted means and deviations, one pair per column."""

    means: dict[str, float]
    deviations: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace each column by its z-score."""
        return df.withColumns(
            {
                c: (F.col(c).cast("double") - F.lit(self.means[c])) / F.lit(self.deviations[c])
                for c in self.means
            }
        )

    def transform_vector(self, df: DataFrame, source: str, output: str) -> DataFrame:
        """Add ``output``, the z-scores of the vector ``source`` whose entries are the fitted columns."""
        entries = vector_to_array(F.col(source))
        scaled = F.array(
            *[
                (entries[i] - F.lit(self.means[c])) / F.lit(self.deviations[c])
                for i, c in enumerate(self.means)
            ]
        )
        return df.withColumn(output, array_to_vector(scaled))

    def save(self, path: str, spark: SparkSession) -> None:
        rows = [(i, c, self.means[c], self.deviations[c]) for i, c in enumerate(self.means)]
        spark.createDataFrame(rows, "pos int, column string, mean double, deviation double").write.mode(
            "overwrite"
        ).parquet(path)

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> Standardizer:
        rows = spark.read.parquet(path).orderBy("pos").collect()
        return cls({r["column"]: r["mean"] for r in rows}, {r["column"]: r["deviation"] for r in rows})


def fit_standardizer(df: DataFrame, columns: list[str]) -> Standardizer:
    """One aggregate over all columns; missing values are skipped, a constant column keeps deviation 1."""
    stats = df.agg(
        *[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"dev_{i}") for i, c in enumerate(columns)],
    ).first()
    return Standardizer(
        {c: stats[f"mean_{i}"] if stats[f"mean_{i}"] is not None else 0.0 for i, c in enumerate(columns)},
        {c: stats[f"dev_{i}"] or 1.0 for i, c in enumerate(columns)},
    )


def fit_vector_standardizer(df: DataFrame, source: str, columns: list[str]) -> Standardizer:
    """The same from a vector column whose entries are ``columns``, without unpacking the vectors."""
    stats = df.select(
        Summarizer.metrics("mean", "variance", "count").summary(F.col(source)).alias("s")
    ).select("s.mean", "s.variance", "s.count").first()
    n = stats["count"]
    share = (n - 1) / n if n > 1 else 0.0  # from the sample to the population variance
    deviations = [(v * share) ** 0.5 for v in stats["variance"]]
    return Standardizer(
        dict(zip(columns, map(float, stats["mean"]), strict=True)),
        {c: float(d) or 1.0 for c, d in zip(columns, deviations, strict=True)},
    )
