import hashlib

import pytest
from edge import edge_rows
from pyspark.sql import functions as F

from custspark.operators import explore, selection
from custspark.schema import KEY


def digest(key, seed=42):
    text = str(seed) if key is None else f"{seed}|{key}"
    return hashlib.md5(text.encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 6, 99, 101, 5000])
def test_exact_number_of_test_rows(spark, n):
    keys = [f"k{i}" for i in range(n)]
    df = spark.createDataFrame([(k, 1) for k in keys], f"{KEY} string, x int").repartition(3)
    train, test = selection.split_exact(df)
    want = set(sorted(keys, key=digest)[: -(-n // 5)])
    assert {r[KEY] for r in test.collect()} == want
    assert {r[KEY] for r in train.collect()} == set(keys) - want


@pytest.mark.parametrize("percent", [0, 1, 50, 99, 100])
def test_other_shares_and_seeds(spark, percent):
    keys = [f"k{i}" for i in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], f"{KEY} string")
    _, test = selection.split_exact(df, percent=percent, seed=7)
    want = sorted(keys, key=lambda k: digest(k, 7))[: 3 * (100 - percent)]
    assert {r[KEY] for r in test.collect()} == set(want)


def test_rows_of_one_key_stay_together(spark):
    keys = [f"k{i % 10}" for i in range(1000)] + [None] * 50
    df = spark.createDataFrame([(k,) for k in keys], f"{KEY} string").repartition(4)
    train, test = selection.split_exact(df)
    ordered = sorted(keys, key=digest)
    last = digest(ordered[209])  # 1,050 rows: the 210th decides
    assert sorted(map(str, (r[KEY] for r in test.collect()))) == sorted(str(k) for k in keys if digest(k) <= last)
    assert train.count() + test.count() == 1050


def test_same_side_in_any_layout(spark, customer_rows):
    cuts = {selection.test_cut(df) for df in (customer_rows, customer_rows.repartition(13), customer_rows.coalesce(1))}
    assert len(cuts) == 1


def test_sample_by_group(spark, customer_rows):
    rows = customer_rows.withColumn("segment", F.when(F.col("age") > 70, F.lit(None)).otherwise(F.col("segment")))
    points = [r.asDict() for r in explore.frequency_vs_lifetime_value(rows).collect()]
    want = {}
    for segment in {p["segment"] for p in points}:
        own = sorted((p for p in points if p["segment"] == segment), key=lambda p: digest(p[KEY]))
        want |= {p[KEY]: {**p, "weight": len(own) / min(20, len(own))} for p in own[:20]}
    for df in (rows, rows.repartition(9), rows.coalesce(1)):
        got = explore.frequency_vs_lifetime_value(df, size=20).collect()
        assert {r[KEY]: r.asDict() for r in got} == want and len(got) == len(want)
    assert sum(p["weight"] for p in want.values()) == pytest.approx(len(points))


def test_small_and_empty_groups_and_repeated_rows(spark):
    rows = edge_rows(spark)
    got = explore.frequency_vs_lifetime_value(rows, size=100)
    assert got.count() == 13 and {r["weight"] for r in got.collect()} == {1.0}
    assert explore.frequency_vs_lifetime_value(edge_rows(spark, []), size=5).count() == 0
    same = edge_rows(spark, [{}] * 7)
    assert [r["weight"] for r in explore.frequency_vs_lifetime_value(same, size=2).collect()] == [3.5, 3.5]
    with pytest.raises(ValueError, match="weight"):
        selection.sample_by_group(rows.withColumn("weight", F.lit(1)), 5, "segment")


def test_plan_cuts_groups_before_the_shuffle(customer_rows):
    plan = explore.frequency_vs_lifetime_value(customer_rows, size=20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4 and "CartesianProduct" not in plan and "NestedLoop" not in plan
