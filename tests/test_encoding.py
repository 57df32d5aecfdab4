import pytest
from edge import edge_rows
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from custspark.operators import encoding, features, scaling
from custspark.schema import CATEGORICALS, FEATURES

ENCODED = [f"{c}_encoded" for c in CATEGORICALS]


def encoded(df):
    return sorted((tuple(r) for r in df.select("customer_id", *ENCODED).collect()), key=repr)


def test_rank_of_sorted_labels_and_missing_as_own_label(spark):
    rows = edge_rows(spark)
    fitted = encoding.fit_encoding(rows)
    assert fitted.labels["favorite_category"] == ["Fashion", "nan"]
    assert fitted.labels["gender"] == ["F", "X"]
    got = {r["customer_id"]: r for r in fitted.transform(rows).collect()}
    assert (got["c00"]["gender_encoded"], got["c08"]["gender_encoded"]) == (0, 1)
    assert got["c08"]["favorite_category_encoded"] == 1
    assert fitted.transform(rows).columns == [*rows.columns, *ENCODED]


def test_unseen_is_minus_one(spark):
    fitted = encoding.fit_encoding(edge_rows(spark, [{}]))
    got = {r["customer_id"]: r for r in fitted.transform(edge_rows(spark)).collect()}
    assert (got["c08"]["gender_encoded"], got["c08"]["favorite_category_encoded"]) == (-1, -1)
    paris = fitted.transform(edge_rows(spark, [{"city": "Paris"}])).first()
    assert (paris["city_encoded"], got["c00"]["city_encoded"]) == (-1, 0)


def test_fit_on_no_rows(spark):
    fitted = encoding.fit_encoding(edge_rows(spark, []))
    assert set(fitted.labels) == set(CATEGORICALS)
    assert {tuple(r) for r in fitted.transform(edge_rows(spark)).select(*ENCODED).collect()} == {(-1,) * 5}


def test_exactly_as_many_labels_as_allowed(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("city"))
    assert not encoding.fit_encoding(df, ["city"], max_in_memory=50).tables
    assert encoding.fit_encoding(df, ["city"], max_in_memory=49).tables


def test_order_is_by_code_point(spark):
    labels = ["Z", "a", "é", "￮", "\U0001f600", "", " b"]
    df = spark.createDataFrame([(v,) for v in labels], "city string")
    want = {v: i for i, v in enumerate(sorted(labels))}
    for bound in (100, 0):
        got = encoding.fit_encoding(df, ["city"], max_in_memory=bound).transform(df).collect()
        assert {r["city"]: r["city_encoded"] for r in got} == want


@pytest.mark.parametrize("bound", [0, 3, 30])
def test_large_columns_give_the_same_result(spark, customer_rows, bound):
    small = encoding.fit_encoding(customer_rows)
    large = encoding.fit_encoding(customer_rows, max_in_memory=bound)
    assert large.tables
    unseen = customer_rows.limit(5).withColumns({"city": F.lit("?"), "gender": F.lit(None).cast("string")})
    rows = customer_rows.union(unseen.select(*customer_rows.columns))
    assert encoded(large.transform(rows)) == encoded(small.transform(rows))


def test_many_labels_in_memory_give_the_same_result(spark, customer_rows, monkeypatch):
    fitted = encoding.fit_encoding(customer_rows)
    rows = customer_rows.union(edge_rows(spark))
    want = encoded(fitted.transform(rows))
    monkeypatch.setattr(encoding, "MAX_INDEXER_LABELS", 5)
    mixed = fitted.transform(rows)
    assert encoded(mixed) == want
    assert "strategy=broadcast" not in mixed._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(encoding, "MAX_INDEXER_LABELS", 0)
    assert encoded(fitted.transform(rows)) == want


def test_ranks_run_on_over_several_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        labels = spark.range(5000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("label"))
        ranked = encoding.rank_labels(labels).collect()
        ranges = labels.repartitionByRange("label").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ranges > 1
    assert {r["label"]: r["idx"] for r in ranked} == {v: i for i, v in enumerate(sorted(r["label"] for r in ranked))}


def test_frequent_and_rare_labels_of_a_large_column(spark):
    """One label holds a third of the rows, the others are rare; all copies alike."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("city")
    )
    fitted = encoding.fit_encoding(rows, ["city"], max_in_memory=10)
    table = fitted.tables["city"]
    assert [r["label"] for r in table.filter("is_hot").collect()] == ["hot"]
    labels = sorted(r["city"] for r in rows.distinct().collect())
    want = {v: i for i, v in enumerate(labels)}
    got = fitted.transform(rows)
    assert got.columns == ["city", "city_encoded"]
    assert got.count() == 6000
    assert {(r["city"], r["city_encoded"]) for r in got.collect()} == set(want.items())


@pytest.mark.parametrize("bound", [100, 3])
def test_save_and_load(spark, customer_rows, tmp_path, bound):
    fitted = encoding.fit_encoding(customer_rows, max_in_memory=bound)
    fitted.save(str(tmp_path / "e"), spark)
    loaded = encoding.CategoryEncoding.load(str(tmp_path / "e"), spark)
    assert loaded.labels == fitted.labels
    assert set(loaded.tables) == set(fitted.tables)
    assert encoded(loaded.transform(customer_rows)) == encoded(fitted.transform(customer_rows))


def test_segment_labels_and_back(spark, customer_rows):
    labels = encoding.fit_segment_labels(customer_rows)
    assert labels == ["At-Risk", "High-Value Loyal", "Occasional", "Regular"]
    coded = encoding.encode_segment(customer_rows, labels)
    back = encoding.decode_segment(coded, labels, "segment_label", "again")
    assert back.filter(~F.col("segment").eqNullSafe(F.col("again"))).count() == 0
    with pytest.raises(Exception, match="NULL"):
        encoding.encode_segment(edge_rows(spark, [{"segment": None}]), labels).collect()
    with pytest.raises(Exception, match="Unseen label: New"):
        encoding.encode_segment(edge_rows(spark, [{"segment": "New"}]), labels).collect()


def test_any_number_of_classes(spark, monkeypatch):
    df = spark.range(150).select(F.col("id").cast("string").alias("segment"))
    want = sorted(str(i) for i in range(150))
    assert encoding.fit_segment_labels(df) == want
    table = encoding.fit_segment_labels(df, max_in_memory=10)
    assert [r["label"] for r in table.orderBy("idx").collect()] == want


def test_more_classes_than_the_driver_may_hold(spark):
    hot = spark.range(60_000).select(F.lit("s7").alias("segment"))
    df = spark.range(150_000).select(F.concat(F.lit("s"), "id").alias("segment")).union(hot).repartition(8)
    df = df.withColumn("a.b", F.lit(1)).withColumn("label", F.lit("own"))
    labels = encoding.fit_segment_labels(df)
    assert not isinstance(labels, list) and labels.count() == 150_000
    coded = encoding.encode_segment(df, labels)
    assert coded.columns == [*df.columns, "segment_label"]
    assert coded.schema["segment_label"].metadata["ml_attr"]["num_vals"] == 150_000
    back = encoding.decode_segment(coded, labels, "segment_label", "again")
    facts = back.agg(
        F.count(F.lit(1)), F.count_distinct("segment_label"), F.max("segment_label"), F.count_if(F.col("segment") == F.col("again"))
    )
    assert tuple(facts.first()) == (210_000, 150_000, 149_999.0, 210_000)


def test_labels_in_a_table_stop_at_what_they_do_not_know(spark):
    fitted = encoding.fit_segment_labels(spark.createDataFrame([("a",), ("b",)], "segment string"), max_in_memory=0)
    df = spark.createDataFrame([("a",), (None,), ("b",), ("new",)], "segment string")
    coded = encoding.encode_segment(df, fitted, skip=True)
    assert {tuple(r) for r in coded.collect()} == {("a", 0.0), ("b", 1.0)}
    for odd in ("segment is null", "segment = 'new'"):
        with pytest.raises(Exception, match="NULL or unseen label"):
            encoding.encode_segment(df.filter(odd), fitted).collect()


def test_rows_without_a_segment_can_be_left_out(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",), ("new",)], "segment string")
    coded = encoding.encode_segment(df, ["a", "b"], skip=True)
    assert {r["segment"] for r in coded.collect()} == {"a", "b"}


def test_standardise_with_a_constant_column_and_missing_values(spark):
    df = spark.createDataFrame([(1.0, 7.0, 2), (3.0, 7.0, None), (None, 7.0, 4)], "a double, b double, c bigint")
    fitted = scaling.fit_standardizer(df, ["a", "b", "c"])
    assert fitted.means == {"a": 2.0, "b": 7.0, "c": 3.0}
    assert fitted.deviations == {"a": 1.0, "b": 1.0, "c": 1.0}
    assert [tuple(r) for r in fitted.transform(df).collect()] == [(-1, 0, -1), (1, 0, None), (None, 0, 1)]


def test_vector_standardizer_is_the_same(spark, customer_rows, tmp_path):
    rows = features.assemble(features.with_features(customer_rows, encoding.fit_encoding(customer_rows)))
    by_column = scaling.fit_standardizer(rows, FEATURES)
    by_vector = scaling.fit_vector_standardizer(rows, "features", FEATURES)
    assert by_vector.means == pytest.approx(by_column.means)
    assert by_vector.deviations == pytest.approx(by_column.deviations)
    scaled = by_vector.transform_vector(rows, "features", "z").select(vector_to_array("z").alias("z")).first()["z"]
    want = by_column.transform(rows).select(*[F.col(c).cast("double") for c in FEATURES]).first()
    assert list(scaled) == pytest.approx(list(want))
    by_column.save(str(tmp_path / "s"), spark)
    loaded = scaling.Standardizer.load(str(tmp_path / "s"), spark)
    assert loaded == by_column and list(loaded.means) == FEATURES


def test_missing_feature_is_an_error_or_skipped(spark):
    rows = edge_rows(spark)
    wide = features.with_features(rows, encoding.fit_encoding(rows))
    with pytest.raises(Exception, match="null while assembling"):
        features.assemble(wide).select("features").collect()
    assert features.assemble(wide, handle_invalid="skip").count() == 12


def test_feature_projection_keeps_the_order(spark):
    rows = edge_rows(spark)
    assert features.project_features(features.with_features(rows, encoding.fit_encoding(rows))).columns == FEATURES
