"""Training and test rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custspark.schema import KEY

# Share of training rows and seed.
TRAIN_PERCENT = 80
SEED = 42


def key_digest(key: str = KEY, seed: int = SEED) -> Column:
    """MD5 of seed and key in hex, by which rows are chosen."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)).cast("binary"))


def is_train(key: str = KEY, percent: int = TRAIN_PERCENT, seed: int = SEED) -> Column:
    """Whether a row is for training, from its key alone.

    The same row lands on the same side whatever the partitioning, the order
    or a task's retry, and for all models. The key's MD5 can be recomputed in
    any other engine.
    """
    bucket = F.conv(F.substring(key_digest(key, seed), 1, 8), 16, 10).cast("bigint") % 100
    return bucket < percent


def split(df: DataFrame, key: str = KEY, percent: int = TRAIN_PERCENT, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    chosen = is_train(key, percent, seed)
    return df.filter(chosen), df.filter(~chosen)
