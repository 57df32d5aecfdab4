from types import SimpleNamespace

from pyspark.sql import functions as F

from custspark.session import materialise, shared_folder


def session(folder=None, context_folder=None):
    """What ``shared_folder`` looks at of a session."""
    settings = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "hdfs:///warehouse"}
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: settings[key] or default),
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: context_folder),
    )


def test_folders_are_new_and_below_the_shared_one(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    one, two = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert one != two and one.startswith(f"{base}/x-") and two.startswith(f"{base}/x-")


def test_folders_are_always_shared_ones():
    assert shared_folder(session("hdfs:///shared/", "hdfs:///other"), "x").startswith("hdfs:///shared/x-")
    assert shared_folder(session(None, "hdfs:///other"), "x").startswith("hdfs:///other/x-")
    assert shared_folder(session(), "x").startswith("hdfs:///warehouse/_intermediate/x-")


def test_materialise_keeps_rows_schema_and_empty_tables(spark):
    df = spark.range(10).select("id", (F.col("id") % 2 == 0).alias("even"))
    for rows in (df, df.filter("id < 0")):
        for partition_by in (None, "even"):
            again = materialise(rows, "t", partition_by)
            assert again.dtypes == rows.dtypes
            assert sorted(again.collect()) == sorted(rows.collect())
