"""Session helpers and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "custspark", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": str(cpus) if str(cpus).isdigit() else "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which every executor can reach.

    Without that setting it is below the context's checkpoint folder, or else below the
    warehouse, which the executors must reach as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str, partition_by: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts the lineage for plans that are read several times. Unlike cached
    blocks the files survive the loss of executors.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    for held in _listening:
        held.append(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _places[stored] = path
    return stored


#: Where the tables that materialise has returned are, and the lists that collect new ones.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_listening: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(*stored: DataFrame) -> None:
    """Delete tables that materialise has returned. Nothing that is still to run may read them."""
    for df in stored:
        remove(df.sparkSession, _places.pop(df))


@contextmanager
def collected() -> Iterator[list[str]]:
    """The folders that materialise makes meanwhile, for ``discard`` once nothing reads them any more."""
    held: list[str] = []
    _listening.append(held)
    try:
        yield held
    finally:
        _listening[:] = [other for other in _listening if other is not held]


def discard(spark: SparkSession, folders: list[str], *keep: DataFrame) -> None:
    """Delete the folders collected, but those of the tables still to be read."""
    kept = {_places[df] for df in keep}
    for path in folders:
        if path not in kept:
            remove(spark, path)
