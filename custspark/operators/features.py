"""From customer rows to feature columns and vectors."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from custspark.functions.missing import nan_to_null
from custspark.functions.scores import with_scores
from custspark.operators.encoding import CategoryEncoding
from custspark.schema import FEATURES


def with_features(df: DataFrame, encoding: CategoryEncoding) -> DataFrame:
    """Add the encoded categories and the scores to the customer columns."""
    return with_scores(encoding.transform(nan_to_null(df)))


def project_features(df: DataFrame) -> DataFrame:
    """The model features alone, in vector order."""
    return df.select(*FEATURES)


def assemble(
    df: DataFrame, columns: list[str] | None = None, output: str = "features", handle_invalid: str = "error"
) -> DataFrame:
    """Add a vector column; a missing value is an error unless ``handle_invalid`` says otherwise."""
    return VectorAssembler(
        inputCols=FEATURES if columns is None else columns, outputCol=output, handleInvalid=handle_invalid
    ).transform(df)
