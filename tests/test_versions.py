"""Types of further columns, previews in file order, tables in versions."""

import glob

import pytest
from edge import edge_rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custspark.schema import CUSTOMER_SCHEMA, KEY
from custspark.sources import csv, tables
from custspark.sources.inference import infer_types, with_inferred_types


def test_types_of_all_cells(spark):
    cases = {
        "whole": (["1", " 2", "-3", "+4"], T.LongType()),
        "gap": (["1", None, "3", "4"], T.DoubleType()),
        "fraction": (["1", "2.5", ".5", "1e3"], T.DoubleType()),
        "infinite": (["1", "inf", "-Infinity", None], T.DoubleType()),
        "flag": (["True", "false", "TRUE", None], T.BooleanType()),
        "mixed_flag": (["True", "1", "0", "False"], T.StringType()),
        "late": (["1", "2", "3", "x"], T.StringType()),
        "long": (["1", "2", "3", "9223372036854775808"], T.StringType()),
        "long_fraction": (["1", "2.5", "3", "9223372036854775808"], T.DoubleType()),
        "empty": ([None] * 4, T.DoubleType()),
        "date.of": (["2024-01-01", "2024-01-02", None, "1"], T.StringType()),
        "hex": (["0x1", "1f", "1d", "2"], T.StringType()),
    }
    rows = list(zip(*[cells for cells, _ in cases.values()], strict=True))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cases])
    for parts in (1, 4):
        df = spark.createDataFrame(rows, schema).repartition(parts)
        assert infer_types(df, list(cases)) == {c: t for c, (_, t) in cases.items()}
    got = with_inferred_types(spark.createDataFrame(rows, schema).coalesce(1), list(cases)).collect()
    assert {r["whole"] for r in got} == {1, 2, -3, 4} and {r["flag"] for r in got} == {True, False, None}
    assert {r["infinite"] for r in got} == {1.0, float("inf"), float("-inf"), None}
    assert {r["fraction"] for r in got} == {1.0, 2.5, 0.5, 1000.0}
    assert infer_types(spark.createDataFrame([], schema), ["whole"]) == {"whole": T.DoubleType()}


def test_further_columns_of_a_file(spark, tmp_path):
    df = edge_rows(spark).withColumns({"visits": F.lit(3), "ok": F.lit(True), "note": F.lit("n")})
    csv.write_customers_csv(df, str(tmp_path / "c"))
    read = csv.read_customers_csv(spark, str(tmp_path / "c"), on_bad_cell="null", further="infer")
    assert dict(read.dtypes)["visits"] == "bigint" and dict(read.dtypes)["ok"] == "boolean"
    assert dict(csv.read_customers_csv(spark, str(tmp_path / "c")).dtypes)["visits"] == "string"
    with pytest.raises(ValueError, match="further"):
        csv.read_customers_csv(spark, str(tmp_path / "c"), further="guess")


def test_preview_in_file_order(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = edge_rows(spark, [{KEY: f"k{i}", "city": "a\nb" if i == 30 else "x"} for i in range(40, 0, -1)])
    csv.write_customers_csv(rows.coalesce(1).sortWithinPartitions(F.lit(1)).repartitionByRange(4, F.desc(KEY)), path)
    files = sorted(glob.glob(f"{path}/*.csv"))
    assert len(files) == 4
    whole = [r for f in files for r in csv.read_customers_csv(spark, f, multi_line=True).collect()]
    # No file behind the first is opened: the last ones are no CSV of customers.
    assert csv.preview_csv(spark, path, 15).collect() == whole[:15]
    assert csv.preview_csv(spark, path, 100).collect() == whole
    for broken in files[1:]:
        with open(broken, "w") as out:
            out.write("nothing\n1\n")
    assert csv.preview_csv(spark, path, 5).collect() == whole[:5]
    with pytest.raises(csv.LoadError):
        csv.preview_csv(spark, path, 15)


def test_a_failed_replacement_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(edge_rows(spark), "versions", path)
    assert tables.load_table(spark, "versions").count() == 13
    broken = edge_rows(spark).withColumn("age", F.when(F.col(KEY) == "c09", F.raise_error(F.lit("stop")).cast("bigint")).otherwise(F.col("age")))
    with pytest.raises(PySparkException):
        tables.replace_table(broken, "versions", path)
    with pytest.raises(ValueError, match="1 keys repeated"):
        tables.replace_table(edge_rows(spark), "versions", path, key=KEY)
    assert tables.load_table(spark, "versions").count() == 13
    assert len(glob.glob(f"{path}/version-*")) == 1
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("versions_")]
    spark.sql("DROP TABLE versions")


def test_old_files_go_last_and_may_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(edge_rows(spark), "kept", path)
    before = tables.load_table(spark, "kept")
    tables.replace_table(before.filter("age > 17"), "kept", path, keep_old=True)
    assert before.count() == 13 and tables.load_table(spark, "kept").count() == 12
    tables.replace_table(tables.load_table(spark, "kept").limit(2), "kept", path)
    assert tables.load_table(spark, "kept").count() == 2
    assert len(glob.glob(f"{path}/version-*")) == 2
    tables.replace_table(tables.load_table(spark, "kept").select(KEY, "age"), "kept", path)
    assert tables.load_table(spark, "kept").columns == [KEY, "age"] and tables.load_table(spark, "kept").count() == 2
    tables.create_table(spark, "kept")
    spark.sql("DROP TABLE kept")


def test_key_checks_and_joins_without_a_shuffle(spark, customer_rows, tmp_path):
    tables.replace_table(customer_rows, "keyed", str(tmp_path / "a"), key=KEY, buckets=4)
    tables.replace_table(customer_rows.select(KEY, "age"), "other", str(tmp_path / "b"), key=KEY, buckets=4)
    keyed, other = spark.table("keyed"), spark.table("other")
    assert keyed.schema.names == CUSTOMER_SCHEMA.names
    assert tuple(tables.key_report(keyed).first()) == (customer_rows.count(), customer_rows.count(), 0, 0)

    def physical(df):
        return df._jdf.queryExecution().executedPlan().toString()

    # One row a task is gathered for the report; nothing is dealt by key.
    for df in (tables.key_report(keyed), tables.duplicate_keys(keyed), keyed.hint("merge").join(other, KEY)):
        assert "hashpartitioning" not in physical(df)
    assert keyed.join(other, KEY).count() == customer_rows.count()
    for name in ("keyed", "other"):
        spark.sql(f"DROP TABLE {name}")
