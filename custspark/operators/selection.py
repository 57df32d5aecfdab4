"""Exact shares and samples of a fixed size by the key's digest, without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custspark.functions.missing import exact
from custspark.operators.split import SEED, TRAIN_PERCENT, key_digest
from custspark.schema import KEY
from custspark.session import forget, materialise

# Hex characters of a digest that one pass tells apart: 4,096 bins, whatever the rows.
DIGITS = 3

# Parts of a group that are reduced on their own before its sample is taken.
LANES = 64


def test_cut(df: DataFrame, key: str = KEY, percent: int = TRAIN_PERCENT, seed: int = SEED) -> str | None:
    """The largest digest of a test row, so that the test rows are exactly the rest of ``percent``, rounded up.

    A radix selection: a pass counts the rows of each of 4,096 bins of the digest's next characters, and
    only the bin that holds the wanted row goes on, a 4,096th of the rows. So the keys are read twice,
    and nothing is sorted but one pass's bins. None for an empty table.
    """
    rows = df.select(key_digest(key, seed).alias("digest"))
    wanted, known, stored = None, 0, None
    while True:
        place = F.substring("digest", known + 1, DIGITS)
        bins = rows.groupBy(place.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")
        )
        found = sorted(bins.collect())
        if wanted is None:
            wanted = -(-sum(b["n"] for b in found) * (100 - percent) // 100)
            if not wanted:
                return None
        for hit in found:
            if wanted <= hit["n"]:
                break
            wanted -= hit["n"]
        if hit["low"] == hit["high"] or wanted in (1, hit["n"]):
            if stored is not None:
                forget(stored)
            return hit["low"] if wanted == 1 else hit["high"]
        smaller = materialise(rows.filter(place == hit["bin"]), "digests")
        if stored is not None:
            forget(stored)
        rows = stored = smaller
        known += DIGITS


def is_exact_train(cut: str | None, key: str = KEY, seed: int = SEED) -> Column:
    """Whether a row is for training, by the digest that ``test_cut`` has found."""
    return F.lit(True) if cut is None else key_digest(key, seed) > cut


def split_exact(df: DataFrame, key: str = KEY, percent: int = TRAIN_PERCENT, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Training rows, and the test rows: those with the smallest digests, ceil((100 - percent) % of all).

    The rows of one key (or of one digest) are on one side: where the last test row's key has more rows,
    all of them are test rows. Rows without a key are one key. Other than by ``split``, a row's
    side depends on the table's other rows.
    """
    chosen = is_exact_train(test_cut(df, key, percent, seed), key, seed)
    return df.filter(chosen), df.filter(~chosen)


def sample_by_group(df: DataFrame, size: int, group: str, key: str = KEY, seed: int = SEED) -> DataFrame:
    """``size`` rows of each group, those with the smallest digests, with ``weight``: the rows that each stands for.

    The same rows whatever the files and the order; a larger ``size`` keeps those of a smaller one. A group
    is reduced in parts by digest first, and then what the parts have kept, so no group meets in one task
    whole. Rows without a group are a group; a smaller group is kept whole, with weight 1. Rows of equal
    keys are taken in the order of their columns. The input must not have a column ``weight``.
    """
    if "weight" in df.columns:
        raise ValueError("a column of this name is added, the input has it already: weight")
    digest = key_digest(key, seed)
    rows = df.select(
        F.struct(*[exact(c) for c in df.columns]).alias("row"), exact(group).alias("part"), digest.alias("digest")
    ).withColumn("lane", F.pmod(F.xxhash64("digest"), F.lit(LANES)))
    for parts in (("part", "lane"), ("part",)):
        place = F.row_number().over(Window.partitionBy(*parts).orderBy("digest", "row"))
        rows = rows.withColumn("place", place).filter(F.col("place") <= size)
    counts = df.groupBy(exact(group).alias("counted")).agg(F.count(F.lit(1)).alias("n"))
    weighted = rows.join(counts, F.col("part").eqNullSafe(F.col("counted")))
    return weighted.select("row.*", (F.col("n") / F.least(F.col("n"), F.lit(size))).alias("weight"))
