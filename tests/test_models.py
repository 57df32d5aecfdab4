from dataclasses import replace

import pytest
from edge import edge_rows
from pyspark.sql import functions as F

from custspark.operators.score import score, spread
from custspark.operators.train import LARGE_FORESTS, MAX_ROWS_PER_TASK, SMALL_FORESTS, CustomerModels, ForestParams, task_count, train
from custspark.app import CustomerAnalytics
from custspark.schema import KEY, SCORING_COLUMNS

QUICK = ForestParams(trees=10, depth=5)
RESULT = [
    "customer_id",
    "churn_probability",
    "will_churn",
    "predicted_clv",
    "predicted_frequency",
    "predicted_segment",
    "customer_health_score",
    "retention_priority",
]


@pytest.fixture(scope="module")
def trained(customer_rows):
    return train(customer_rows, QUICK)


def values(metrics):
    return {f"{r['model']}_{r['metric']}": r["value"] for r in metrics.collect()}


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_models_beat_the_trivial_ones(customer_rows, trained):
    got = values(trained[1])
    assert set(got) == {"churn_accuracy", "clv_r2", "clv_mae", "frequency_r2", "frequency_mae", "segment_accuracy"}
    n = customer_rows.count()
    stay = customer_rows.filter("churn_probability <= 0.5").count() / n
    largest = max(r["count"] for r in customer_rows.groupBy("segment").count().collect()) / n
    assert got["churn_accuracy"] > stay and got["segment_accuracy"] > largest
    assert got["clv_r2"] > 0.3 and got["frequency_r2"] > 0.8
    assert got["clv_mae"] > 0 and got["frequency_mae"] > 0


def test_same_seed_gives_the_same_models(customer_rows, trained):
    again = train(customer_rows.sortWithinPartitions(F.desc("age")), QUICK)
    assert values(again[1]) == values(trained[1])


def test_a_table_in_one_file_is_scored_by_all_cores(customer_rows, trained):
    one = customer_rows.coalesce(1)
    df = score(spread(one), trained[0])
    assert df.rdd.getNumPartitions() >= one.sparkSession.sparkContext.defaultParallelism
    assert df.count() == one.count()


def test_scores(customer_rows, trained):
    df = score(customer_rows, trained[0])
    assert df.columns == RESULT
    rows = df.collect()
    assert len(rows) == customer_rows.count() == len({r[KEY] for r in rows})
    for r in rows:
        assert 0 <= r["churn_probability"] <= 1
        assert r["will_churn"] == (r["churn_probability"] > 0.5) or r["churn_probability"] == 0.5
        p = r["churn_probability"]
        assert r["retention_priority"] == ("HIGH" if p > 0.5 else "MEDIUM" if p > 0.3 else "LOW")
        assert 0 <= r["customer_health_score"] <= 100
        assert r["predicted_segment"] in trained[0].segment_labels


def test_health_score_of_the_batch(customer_rows, trained):
    best = customer_rows.agg(F.max(F.col("email_open_rate") * F.col("click_through_rate"))).first()[0]
    rows = score(customer_rows, trained[0]).join(customer_rows.drop("churn_probability"), KEY)
    want = (
        (1 - F.col("churn_probability")) * 0.4
        + F.col("email_open_rate") * F.col("click_through_rate") / (best + 0.01) * 0.3
        + (F.col("nps_score") + 100) / 200 * 0.3
    ) * 100
    assert rows.filter(F.abs(want - F.col("customer_health_score")) > 1e-9).count() == 0
    fixed = score(customer_rows, trained[0], reference_max=best)
    assert rows_of(fixed) == rows_of(score(customer_rows, trained[0]))
    part = score(customer_rows.filter("age < 30"), trained[0], reference_max=best)
    assert set(rows_of(part)) <= set(rows_of(fixed))


def test_scoring_needs_no_labels_and_takes_unseen_categories(spark, customer_rows, trained):
    inputs = edge_rows(spark).filter(f"{KEY} not in ('c09')").select(*SCORING_COLUMNS)
    assert score(inputs, trained[0]).count() == 12
    unlabelled = score(customer_rows.select(*SCORING_COLUMNS), trained[0])
    assert rows_of(unlabelled) == rows_of(score(customer_rows, trained[0]))


def test_scoring_plan_has_no_shuffle_and_no_python(customer_rows, trained):
    plan = score(customer_rows, trained[0], reference_max=0.5)._jdf.queryExecution().executedPlan().toString()
    for word in ("Exchange", "Python", "CartesianProduct", "NestedLoop"):
        assert word not in plan


def test_save_and_load(customer_rows, trained, tmp_path):
    trained[0].save(str(tmp_path / "m"))
    loaded = CustomerModels.load(str(tmp_path / "m"))
    assert loaded.params == QUICK
    assert rows_of(score(customer_rows, loaded)) == rows_of(score(customer_rows, trained[0]))


def test_target_features_can_be_left_out(customer_rows, trained):
    models, metrics = train(customer_rows, QUICK, exclude_target_features=True)
    assert models.frequency.numFeatures == 22 and models.clv.numFeatures == 24
    assert values(metrics)["clv_r2"] == values(trained[1])["clv_r2"]
    assert score(customer_rows, models).count() == customer_rows.count()


def test_unusable_labels(spark, customer_rows):
    with pytest.raises(ValueError, match="only one churn class"):
        train(customer_rows.withColumn("churn_probability", F.lit(0.1)), QUICK)
    with pytest.raises(ValueError, match="customer_lifetime_value"):
        blank = F.when(F.col("age") > 20, F.col("customer_lifetime_value"))
        train(customer_rows.withColumn("customer_lifetime_value", blank), QUICK)
    with pytest.raises(Exception, match="NULL"):
        train(customer_rows.withColumn("segment", F.when(F.col("age") > 20, F.col("segment"))), QUICK)
    with pytest.raises(ValueError, match="both training and test rows"):
        train(customer_rows.limit(1), QUICK)


def test_task_count():
    assert [task_count(n) for n in (0, 999, 5000, 10**5, 10**7, 10**10)] == [1, 1, 5, 8, 10, 10**4]


def test_features_per_split_by_kind_of_model():
    assert SMALL_FORESTS.as_arguments(1)["featureSubsetStrategy"] == "sqrt"
    assert SMALL_FORESTS.as_arguments(1, regression=True)["featureSubsetStrategy"] == "all"
    assert ForestParams().as_arguments(1, regression=True)["featureSubsetStrategy"] == "auto"


def test_many_segments_train_and_score(customer_rows):
    many = customer_rows.withColumn("segment", F.concat(F.lit("s"), F.pmod(F.xxhash64(KEY), F.lit(150))))
    models, metrics = train(many, ForestParams(trees=2, depth=3))
    assert len(models.segment_labels) == 150 and metrics.count() == 6
    assert score(many, models).count() == many.count()


def test_class_labels_in_a_table_give_the_same_models(spark, customer_rows, trained, tmp_path):
    models, metrics = train(customer_rows, QUICK, max_labels_in_memory=0)
    assert not isinstance(models.segment_labels, list)
    assert values(metrics) == values(trained[1])
    want = rows_of(score(customer_rows, trained[0]))
    assert rows_of(score(customer_rows, models)) == want
    models.save(str(tmp_path / "m"))
    assert rows_of(score(customer_rows, CustomerModels.load(str(tmp_path / "m")))) == want


def test_skipped_rows_set_no_scale_and_missing_segments_can_be_skipped(customer_rows, trained):
    best = customer_rows.agg(F.max(F.col("email_open_rate") * F.col("click_through_rate"))).first()[0]
    usual = rows_of(score(customer_rows, trained[0], reference_max=best))
    odd = customer_rows.limit(1).withColumns(
        {KEY: F.lit("odd"), "email_open_rate": F.lit(9.0), "click_through_rate": F.lit(9.0), "age": F.lit(None).cast("bigint")}
    )
    assert rows_of(score(customer_rows.union(odd), trained[0], handle_invalid="skip")) == usual
    gaps = customer_rows.withColumn("segment", F.when(F.col("age") > 20, F.col("segment")))
    assert train(gaps, QUICK, handle_invalid="skip")[1].count() == 6


def test_node_ids_are_cached_while_small():
    assert ForestParams().as_arguments(80_000)["cacheNodeIds"]
    assert not ForestParams().as_arguments(90_000)["cacheNodeIds"]
    assert ForestParams(cache_node_ids=True).as_arguments(10**9)["cacheNodeIds"]
    assert not ForestParams(cache_node_ids=False).as_arguments(1)["cacheNodeIds"]


def test_the_forests_in_use_keep_node_ids_whatever_the_rows(customer_rows):
    for forests in (LARGE_FORESTS, SMALL_FORESTS):
        assert forests.as_arguments(MAX_ROWS_PER_TASK)["cacheNodeIds"]
        assert forests.as_arguments(MAX_ROWS_PER_TASK, regression=True)["cacheNodeIds"]
    kept, found = (values(train(customer_rows, replace(QUICK, cache_node_ids=c))[1]) for c in (True, False))
    assert kept == pytest.approx(found, rel=1e-9)


def test_forest_sizes():
    assert (ForestParams().trees, ForestParams().depth, ForestParams().seed) == (100, 10, 42)
    assert (SMALL_FORESTS.trees, SMALL_FORESTS.depth) == (50, 8)


def test_whole_flow(spark, customer_rows, tmp_path):
    from custspark.sources.csv import write_customers_csv

    app = CustomerAnalytics(spark, "flow")
    app.create_table()
    write_customers_csv(customer_rows, str(tmp_path / "csv"))
    app.save(app.read_csv(str(tmp_path / "csv")))
    assert rows_of(app.load()) == rows_of(customer_rows)
    with pytest.raises(RuntimeError):
        app.score()
    assert app.train(params=QUICK).count() == 6
    scored = rows_of(app.score())
    app.save_models(str(tmp_path / "m"))
    other = CustomerAnalytics(spark, "flow")
    other.load_models(str(tmp_path / "m"))
    assert rows_of(other.score()) == scored
    assert {name: df.count() for name, df in app.report().items()}["preview"] == 10
    assert app.features(app.load()).columns[-1] == "email_engagement"
    with pytest.raises(ValueError, match="1 keys repeated"):
        app.save(customer_rows.union(customer_rows.limit(1)), check_key=True)
    form = edge_rows(spark, [{"age": None, "city": "Dhaka"}, {"age": 17}]).select(*SCORING_COLUMNS)
    scores, refused = app.score_inputs(form)
    assert (scores.count(), refused.count()) == (1, 1)
    valid, rejected = app.validate(app.load())
    assert valid.count() + rejected.count() == customer_rows.count()


def test_models_depend_on_rows_and_not_on_files(spark, tmp_path):
    """Several tasks of rows, from one, five and fifty files."""
    from custspark.plans.customers import customers

    rows = customers(spark, "/root/testdata/sf0.1")
    rows.coalesce(1).write.parquet(str(tmp_path / "1"))
    one = spark.read.parquet(str(tmp_path / "1"))
    assert task_count(one.count()) > 4
    for n in (5, 50):
        one.repartition(n).write.parquet(str(tmp_path / str(n)))
    got = [values(train(spark.read.parquet(str(tmp_path / str(n))), QUICK)[1]) for n in (1, 5, 50)]
    assert got[0] == pytest.approx(got[1], rel=1e-9) and got[0] == pytest.approx(got[2], rel=1e-9)


def test_tables_with_other_columns(customer_rows, trained):
    """Names that training and scoring use themselves, and one with a dot, change nothing."""
    names = ["features", "frequency_vector", "segment_label", "predicted_clv", "will_churn", "gender_encoded", "is_train", "a.b", "text0", "deal"]
    wide = customer_rows.withColumns({n: F.lit("x") for n in names})
    assert values(train(wide, QUICK)[1]) == values(trained[1])
    assert rows_of(score(wide, trained[0])) == rows_of(score(customer_rows, trained[0]))
