"""Types of text columns, from all of their cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custspark.functions.missing import exact

# The texts that are truth values, and the forms of numbers.
TRUE, FALSE = ["True", "TRUE", "true"], ["False", "FALSE", "false"]
WHOLE = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"


def _facts(name: str) -> Column:
    """What a column's cells are, as counts; counts of any two parts of the rows add up."""
    text = F.trim(exact(name))
    return F.struct(
        F.count(F.lit(1)).alias("rows"),
        F.count(text).alias("cells"),
        F.count_if(text.rlike(WHOLE)).alias("whole"),
        F.count_if(text.rlike(WHOLE) & text.try_cast("bigint").isNull()).alias("too_long"),
        F.count_if(text.rlike(NUMBER)).alias("numbers"),
        F.count_if(exact(name).isin(TRUE + FALSE)).alias("flags"),
    )


def _decided(facts) -> T.DataType:
    """The narrowest of whole number, fraction, truth value and text that holds every cell."""
    if facts["numbers"] == facts["cells"]:
        if facts["whole"] == facts["cells"] and facts["too_long"]:
            return T.StringType()  # no digit may be lost
        return T.LongType() if 0 < facts["whole"] == facts["rows"] else T.DoubleType()
    return T.BooleanType() if facts["flags"] == facts["cells"] else T.StringType()


def infer_types(df: DataFrame, columns: Sequence[str]) -> dict[str, T.DataType]:
    """The type of each text column, from one pass over all rows.

    Whole numbers without a gap are bigint, other numbers double (whole ones with a gap and columns
    without any cell as well), truth values boolean, the rest text. Whole numbers beyond a bigint stay text.
    One late cell decides as much as the first.
    """
    if not columns:
        return {}
    facts = df.agg(*[_facts(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: _decided(facts[f"c{i}"]) for i, c in enumerate(columns)}


def typed(name: str, data_type: T.DataType) -> Column:
    """A text column as the type that was inferred."""
    text = exact(name)
    if isinstance(data_type, T.StringType):
        return text
    if isinstance(data_type, T.BooleanType):
        return F.when(text.isNotNull(), text.isin(TRUE)).alias(name)
    return F.trim(text).try_cast(data_type).alias(name)


def with_inferred_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the given text columns in their inferred types; the pass runs when this is called."""
    types = infer_types(df, columns)
    return df.select(*[typed(c, types[c]) if c in types else exact(c) for c in df.columns])
