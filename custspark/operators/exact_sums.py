"""Sums and means of doubles that are the same for every order and layout of the rows.

A double is cut into whole numbers on a grid of powers of 2^16, exactly. Their sums are whole numbers too,
so they can be merged in any order; the total is rounded to a double once, at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custspark.functions.missing import exact

# Bits of one place of the grid. A row adds less than 2^17 to a place, so 2^45 rows fit a bigint.
BITS = 16
BASE = 1 << BITS
# Places below a value's highest one that its 53 bits can reach, with one to spare.
BELOW = 4
# Empty places around a total: above for what is carried, below for the five places that are rounded.
PADDING = 5


def _times_power(value: Column, exponent: Column) -> Column:
    """``value`` times 2^exponent in two steps, none of which leaves the range of doubles before the result does."""
    half = F.floor(exponent / 2)
    return value * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), exponent - half)


def _places(x: Column, top: Column) -> list[tuple[Column, Column]]:
    """(place, whole number) pairs whose sum is ``x``; ``top`` is the place of its leading bit."""
    scaled = _times_power(x, top * -BITS)
    pieces = [(top, scaled.cast("bigint"))]
    for i in range(BELOW):
        # The remainder of a division by one is exact, as is every product with a power of two.
        piece = (scaled * float(BASE**i)) % F.lit(1.0) * float(BASE)
        pieces.append((top - (i + 1), piece.cast("bigint")))
    return pieces


def _carried(amounts: Column) -> Column:
    """(carry, digits): the amounts, lowest place first, as digits below 2^16; the carry is -1 for a negative total."""
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("digits"))

    def step(state: Column, amount: Column) -> Column:
        here = state["carry"] + amount
        return F.struct(
            F.shiftright(here, BITS).alias("carry"),
            F.concat(state["digits"], F.array(here.bitwiseAND(F.lit(BASE - 1).cast("bigint")))).alias("digits"),
        )

    return F.aggregate(amounts, start, step)


def _rounded(places: DataFrame) -> DataFrame:
    """``total`` from ``amounts``, a map from places to whole numbers: the nearest double, ties to even."""
    keys = F.map_keys("amounts")
    df = places.withColumn("low", F.array_min(keys) - PADDING).withColumn("high", F.array_max(keys) + PADDING)
    dense = F.transform(F.sequence("low", "high"), lambda p: F.coalesce(F.try_element_at("amounts", p), F.lit(0)))
    df = df.withColumn("dense", dense).withColumn("sums", _carried(F.col("dense")))
    negative = F.col("sums")["carry"] < 0
    opposite = _carried(F.transform("dense", lambda amount: -amount))
    df = df.withColumn("digits", F.when(negative, opposite["digits"]).otherwise(F.col("sums")["digits"]))
    df = df.withColumn("first", F.array_max(F.transform("digits", lambda d, i: F.when(d != 0, i))))

    def digit(back: int) -> Column:
        return F.get("digits", F.col("first") - back)

    # Five places have at least 65 bits. The upper three and the lower two are doubles without rounding, and
    # so is one bit for all that is below; one addition rounds their sum as it would round the total.
    upper = digit(0) * BASE**2 + digit(1) * BASE + digit(2)
    lower = digit(3) * BASE + digit(4)
    rest = F.exists(F.slice("digits", 1, F.greatest(F.col("first") - 4, F.lit(0))), lambda d: d != 0)
    rounded = upper.cast("double") * float(2 * BASE**2) + (lower * 2 + rest.cast("bigint")).cast("double")
    sign = F.when(negative, F.lit(-1.0)).otherwise(F.lit(1.0))
    total = _times_power(sign * rounded, (F.col("first") + F.col("low") - 4) * BITS - 1)
    return df.withColumn("total", F.when(F.col("first").isNull(), F.lit(0.0)).otherwise(total))


def exact_sums(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``column``, ``total`` and ``n``: the sum and number of each column's values in each group.

    The total is the exact sum, rounded once (twice if it is smaller than 2^-1022). NULL and NaN
    are missing; a group without a value has the total NULL and n 0. Infinite values give what adding them
    gives. Without ``by`` an empty table has no row. Tasks send a row for each group, column and range of
    16 binary orders of magnitude.
    """
    group = F.struct(*[exact(c) for c in by]) if by else F.lit(0)
    values = F.array(*[exact(c).cast("double") for c in columns])
    rows = df.select(group.alias("g"), F.posexplode(values).alias("c", "given"))
    infinite = F.abs("given") == float("inf")
    x = F.when(~infinite, F.nanvl("given", F.lit(None)))
    rows = rows.withColumn("x", x).withColumn("odd", F.when(infinite, F.col("given")))
    # Zero has no leading bit; a logarithm that is rounded across a power of two does no harm.
    top = F.when(F.col("x") != 0, F.floor(F.log2(F.abs("x")) / BITS)).otherwise(F.lit(0)).cast("bigint")
    rows = rows.withColumn("top", top)
    pieces = _places(F.col("x"), F.col("top"))
    summed = rows.groupBy("g", "c", "top").agg(
        *[F.coalesce(F.sum(amount), F.lit(0)).alias(f"a{i}") for i, (_, amount) in enumerate(pieces)],
        F.sum("odd").alias("odd"),
        F.count(F.nanvl("given", F.lit(None))).alias("n"),
    )
    # From here on there are some hundred rows a group and column at most.
    placed = summed.select(
        "g", "c", F.inline(F.array(*[
            F.struct((F.col("top") - i).alias("place"), F.col(f"a{i}").alias("amount"), _first(i, "odd"), _first(i, "n"))
            for i in range(len(pieces))
        ]))
    )
    merged = placed.groupBy("g", "c", "place").agg(
        F.sum("amount").alias("amount"), F.sum("odd").alias("odd"), F.sum("n").alias("n")
    )
    amounts = F.map_from_entries(F.collect_list(F.struct("place", "amount"))).alias("amounts")
    totals = _rounded(merged.groupBy("g", "c").agg(amounts, F.sum("odd").alias("odd"), F.sum("n").alias("n")))
    total = F.when(F.col("n") > 0, F.coalesce("odd", "total")).alias("total")
    names = F.array(*[F.lit(c) for c in columns])
    return totals.select(*(["g.*"] if by else []), F.get(names, F.col("c")).alias("column"), total, "n")


def _first(i: int, name: str) -> Column:
    """A group's figure, carried by the first of its places alone."""
    return (F.col(name) if i == 0 else F.lit(None).cast("double" if name == "odd" else "bigint")).alias(name)


def exact_means(df: DataFrame, names: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """One row a group (one in all without ``by``) with the means of columns under new names."""
    sums = exact_sums(df, list(names), by)
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    return sums.groupBy(*[exact(c) for c in by]).agg(
        *[F.max(F.when(F.col("column") == c, mean)).alias(name) for c, name in names.items()]
    )
