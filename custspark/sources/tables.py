"""The customer table in the catalog."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custspark.schema import CUSTOMER_SCHEMA, KEY
from custspark.session import materialise, remove

DEFAULT_TABLE = "customers"


def create_table(spark: SparkSession, name: str = DEFAULT_TABLE, path: str | None = None) -> None:
    """Create the empty customer table unless there is one."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CUSTOMER_SCHEMA)
    location = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{location}")


def save_table(df: DataFrame, name: str = DEFAULT_TABLE, path: str | None = None, check_key: bool = False) -> None:
    """Replace the table, schema included; ``df`` may be made from the table itself.

    With ``check_key`` rows without a key, or with one that is there twice, stop it before anything is replaced.
    """
    if check_key:
        _require_key(df, KEY)
    try:
        _write(df, name, path)
    except AnalysisException as error:
        if not (error.getCondition() or "").startswith("UNSUPPORTED_OVERWRITE"):
            raise
        # The new rows come from the files about to be replaced: they are written elsewhere first.
        _write(materialise(df, "replacement"), name, path)


def _write(df: DataFrame, name: str, path: str | None) -> None:
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def _described(spark: SparkSession, name: str) -> dict[str, str]:
    """The catalog's facts about a table, by their names."""
    return {row["col_name"]: row["data_type"] for row in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}


def replace_table(
    df: DataFrame,
    name: str,
    path: str,
    key: str | None = None,
    buckets: int = 64,
    keep_old: bool = False,
) -> None:
    """Replace the table by a new version below ``path``; the old one can be read until the new one is whole.

    The rows are written beside the old version, and only then the table is pointed to them; a job that
    fails changes nothing. The old version's files, if they are below ``path``, go last (``keep_old`` leaves them to
    readers that are still at work). ``df`` may be made from the table itself.

    With ``key`` the table is bucketed by it and sorted inside the buckets, so that key checks, groupings and
    joins by key need no shuffle, and it is a primary key: a missing or repeated one stops the
    replacement. The number of ``buckets`` should follow the table's size.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    version, staged = f"{path.rstrip('/')}/version-{mark}", f"{name}_new_{mark}"
    try:
        writer = df.write.format("parquet").option("path", version)
        if key:
            # All rows of a bucket in one task, so that a bucket is one sorted file.
            writer = df.repartition(buckets, key).write.format("parquet").option("path", version)
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(staged)
        if key:
            _require_key(spark.table(staged), key)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        remove(spark, version)
        raise
    if not spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
        return
    old, new = _described(spark, name), _described(spark, staged)
    layout = ("Num Buckets", "Bucket Columns", "Sort Columns")
    same_layout = [old.get(c) for c in layout] == [new.get(c) for c in layout] and old.get("Type") == "EXTERNAL"
    if same_layout and spark.table(name).dtypes == spark.table(staged).dtypes:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{version}'")
        spark.sql(f"DROP TABLE {staged}")
    else:
        # Another schema is another table: it takes the name, and the old one goes after that.
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}_old_{mark}")
        spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
        spark.sql(f"DROP TABLE {name}_old_{mark}")
    spark.catalog.refreshTable(name)
    if f"{path.rstrip('/')}/version-" in old["Location"] and not keep_old:
        remove(spark, old["Location"])


def _require_key(df: DataFrame, key: str) -> None:
    report = key_report(df, key).first()
    if report["n_missing_keys"] or report["n_duplicate_keys"]:
        raise ValueError(f"{report['n_missing_keys']} rows without a key, {report['n_duplicate_keys']} keys repeated")


def load_table(spark: SparkSession, name: str = DEFAULT_TABLE) -> DataFrame:
    return spark.table(name)


def duplicate_keys(df: DataFrame, key: str = KEY) -> DataFrame:
    """Keys that occur more than once, with their number of rows; counts are pre-summed before the shuffle."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def key_report(df: DataFrame, key: str = KEY) -> DataFrame:
    """One row: rows, distinct keys, rows without a key, keys used more than once."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    present = F.col(key).isNotNull()
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count_if(present).alias("n_keys"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("n_missing_keys"),
        F.count_if(present & (F.col("n") > 1)).alias("n_duplicate_keys"),
    )
