import math
import random

import pytest
from edge import edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from custspark.operators import explore
from custspark.operators.exact_sums import exact_means, exact_sums

INF, NAN = float("inf"), float("nan")


def totals(spark, groups):
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g int, x double").repartition(3)
    return {r["g"]: (r["total"], r["n"]) for r in exact_sums(df, ["x"], ["g"]).collect()}


def assert_exact(spark, groups):
    got = totals(spark, groups)
    for g, values in groups.items():
        present = [v for v in values if v is not None]
        assert got[g] == (math.fsum(present) if present else None, len(present)), (g, values)


@settings(max_examples=4, deadline=None)
@given(
    lists=st.lists(
        st.lists(st.one_of(st.none(), st.floats(-1e300, 1e300, allow_subnormal=False)), min_size=1, max_size=12),
        min_size=1,
        max_size=40,
    )
)
def test_any_doubles(spark, lists):
    assert_exact(spark, dict(enumerate(lists)))


def test_hard_cases(spark):
    ulp = 2.0**-53
    cases = [
        [1e100, 1.0, -1e100],
        [1.0, ulp],  # a tie, to even: 1.0
        [1.0, ulp, 2.0**-200],  # just above the tie
        [-1.0, -ulp, -(2.0**-200)],
        [1.0 + 2 * ulp, ulp],  # a tie, to even: up
        [0.0, -0.0],
        [5e-324] * 3,
        [-5e-324, 2.2250738585072014e-308],
        [1.7e308, -1.7e308, 3.0],
        [0.1] * 10,
        [2.0**16, 2.0**32, 2.0**-16, 2.0**48 - 1, -(2.0**64)],
        [math.nextafter(2.0**k, 0.0) for k in range(-64, 65, 16)],
        [None],
    ]
    assert_exact(spark, dict(enumerate(cases)))
    rng = random.Random(7)
    wide = {g: [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randrange(-300, 300) for _ in range(200)] for g in range(20)}
    near = {g + 100: [rng.gauss(1000, 300) for _ in range(200)] for g in range(20)}
    assert_exact(spark, wide | near)


def test_missing_and_infinite(spark):
    got = totals(spark, {0: [NAN, None], 1: [INF, 1.0], 2: [-INF, NAN], 3: [INF, -INF]})
    assert got[0] == (None, 0) and got[1] == (INF, 2) and got[2] == (-INF, 1)
    assert math.isnan(got[3][0]) and got[3][1] == 2


def test_bits_do_not_depend_on_the_layout(spark, customer_rows):
    layouts = [customer_rows.coalesce(1), customer_rows.repartition(7), customer_rows.orderBy(F.desc("total_spent"))]
    summaries = {explore.kpi_summary(df, exact=True).first() for df in layouts}
    means = {tuple(explore.mean_by_segment(df, "total_spent", "m", exact=True).collect()) for df in layouts}
    assert len(summaries) == len(means) == 1
    spent = [r[0] for r in customer_rows.select("total_spent").collect()]
    assert exact_means(customer_rows, {"total_spent": "m"}).first()["m"] == math.fsum(spent) / len(spent)


def test_exact_as_the_usual_means(spark):
    rows = edge_rows(spark).withColumn("a.b", F.lit(1))
    usual, exact = explore.kpi_summary(rows).first().asDict(), explore.kpi_summary(rows, exact=True).first().asDict()
    assert usual == pytest.approx(exact) and list(usual) == list(exact)
    assert exact_sums(rows, ["a.b"]).first()["total"] == 13.0
    none = edge_rows(spark, [])
    assert explore.kpi_summary(none, exact=True).first() == explore.kpi_summary(none).first()
    assert explore.mean_by_segment(none, "age", "m", exact=True).count() == 0
    assert exact_sums(none, ["age"], ["segment"]).count() == 0
