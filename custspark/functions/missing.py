"""Missing values: one representation, NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custspark.schema import NA_TOKENS


def exact(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_null(column: Column) -> Column:
    """NULL for every text that stands for a missing cell."""
    return F.when(~column.isin(NA_TOKENS), column)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL: Spark orders NaN above all numbers, so NaN > 0.5 would hold."""
    fractional = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.nanvl(exact(c), F.lit(None)).alias(c) if c in fractional else exact(c) for c in df.columns])


def category(column: Column | str) -> Column:
    """A categorical value as text; a missing one is a category of its own, ``nan``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("nan"))
