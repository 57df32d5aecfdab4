"""Input checks and default values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custspark.schema import DEFAULTS, DOMAINS, RANGES


def _violations(df: DataFrame, ranges: dict, domains: dict) -> dict[str, Column]:
    """Rule name to condition; a missing value, NaN included, breaks no rule."""
    rules: dict[str, Column] = {}
    for name, (low, high) in ranges.items():
        if name in df.columns:
            value = F.nanvl(name, F.lit(None)) if dict(df.dtypes)[name] in ("double", "float") else F.col(name)
            if low is not None:
                rules[f"{name}_below_{low}"] = value < low
            if high is not None:
                rules[f"{name}_above_{high}"] = value > high
    for name, allowed in domains.items():
        if name in df.columns:
            rules[f"{name}_unknown"] = ~F.col(name).isin(allowed)
    return rules


def _broken(df: DataFrame, ranges: dict, domains: dict) -> Column:
    """The names of the broken rules."""
    rules = _violations(df, ranges, domains)
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def _refuse(df: DataFrame, *names: str) -> None:
    taken = [n for n in names if n in df.columns]
    if taken:
        raise ValueError(f"columns of these names are added, the input has them already: {', '.join(taken)}")


def with_violations(df: DataFrame, ranges: dict = RANGES, domains: dict = DOMAINS) -> DataFrame:
    """Add ``violations``, the names of the broken rules, and ``is_valid``; the input must not have them."""
    _refuse(df, "violations", "is_valid")
    return df.withColumn("violations", _broken(df, ranges, domains)).withColumn("is_valid", F.size("violations") == 0)


def split_valid(df: DataFrame, ranges: dict = RANGES, domains: dict = DOMAINS) -> tuple[DataFrame, DataFrame]:
    """Valid rows with the input's columns, and rejected rows with their ``violations``."""
    _refuse(df, "violations")
    broken = _broken(df, ranges, domains)
    return df.filter(F.size(broken) == 0), df.filter(F.size(broken) > 0).withColumn("violations", broken)


def with_quality_flags(df: DataFrame) -> DataFrame:
    """Add ``score_flags``: which scores have no value although their input has one."""
    flags = {
        "recency_undefined": F.col("last_purchase_days") == -1,
        "frequency_undefined": F.col("purchase_frequency") <= -1,
        "monetary_undefined": F.col("total_spent") <= -1,
    }
    return df.withColumn(
        "score_flags", F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in flags.items()]))
    )


def fill_defaults(df: DataFrame, defaults: dict = DEFAULTS) -> DataFrame:
    """Replace missing values by the defaults of the columns that are present."""
    return df.fillna({c: v for c, v in defaults.items() if c in df.columns})
