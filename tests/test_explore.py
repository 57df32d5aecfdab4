import pytest
from edge import edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from custspark.operators import encoding, explore, quality, split
from custspark.schema import DEFAULTS, KEY


def test_rows_without_segment_count_in_totals_only(spark):
    rows = edge_rows(spark)
    summary = explore.kpi_summary(rows).first()
    assert (summary["total_customers"], summary["total_columns"]) == (13, 24)
    assert (summary["high_value_customers"], summary["at_risk_customers"]) == (1, 1)
    assert explore.high_value(rows).count() == 1 and explore.at_risk(rows).count() == 1
    shares = [tuple(r) for r in explore.segment_distribution(rows).collect()]
    assert shares == [("Regular", 11, pytest.approx(11 / 12)), ("High-Value Loyal", 1, pytest.approx(1 / 12))]
    means = explore.mean_by_segment(rows, "customer_lifetime_value", "m").collect()
    assert [tuple(r) for r in means] == [("High-Value Loyal", 1000.0), ("Regular", 1000.0)]


def test_bands_add_up(spark):
    got = {r["risk_band"]: r["n_customers"] for r in explore.churn_bands(edge_rows(spark)).collect()}
    assert got == {"Low Risk": 10, "Medium Risk": 2, "High Risk": 1}


def test_empty_table(spark):
    none = edge_rows(spark, [])
    assert explore.kpi_summary(none).first()["total_customers"] == 0
    for df in (explore.churn_bands(none), explore.segment_distribution(none), explore.histogram(none, "total_spent")):
        assert df.count() == 0


def test_preview_is_in_key_order(spark, customer_rows):
    keys = [r[KEY] for r in explore.preview(customer_rows).collect()]
    assert len(keys) == 10 and keys == sorted(keys)
    assert keys[0] == customer_rows.agg(F.min(KEY)).first()[0]


@pytest.mark.parametrize("round_width", [False, True])
@settings(max_examples=6, deadline=None)
@given(values=st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=1, max_size=40))
def test_histogram_counts_every_value_once(spark, round_width, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    bins = explore.histogram(df, "x", 10, round_width).collect()
    present = [v for v in values if v is not None]
    assert sum(b["n_customers"] for b in bins) == len(present)
    assert len(bins) <= (11 if round_width else 10)
    slack = 1e-9 * max([1.0, *map(abs, present)])
    for b in bins:
        inside = [v for v in present if b["bin_start"] - slack <= v <= b["bin_end"] + slack]
        assert len(inside) >= b["n_customers"]


def test_histogram_bounds(spark):
    odd = [(float("nan"),), (None,), (float("inf"),), (float("-inf"),)]
    df = spark.createDataFrame([(float(v),) for v in range(101)] + odd, "x double")
    bins = explore.histogram(df, "x", 50).collect()
    assert [b["n_customers"] for b in bins] == [2] * 49 + [3]
    assert (bins[0]["bin_start"], bins[-1]["bin_end"]) == (0.0, 100.0)
    rounded = explore.histogram(df.filter("x > 2"), "x", 30, round_width=True).collect()
    assert [(b["bin_start"], b["n_customers"]) for b in rounded[:2]] == [(0.0, 2), (5.0, 5)]
    gaps = explore.histogram(df.filter("x in (0, 100)"), "x", 10).collect()
    assert [b["n_customers"] for b in gaps] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    flat = explore.histogram(df.filter("x = 7"), "x").collect()
    assert [tuple(b) for b in flat] == [(0, 7.0, 8.0, 1)]


def test_violations(spark):
    rows = quality.with_violations(edge_rows(spark)).collect()
    broken = {tuple(r["violations"]) for r in rows if not r["is_valid"]}
    assert broken == {
        ("age_below_18", "cart_abandonment_rate_above_1", "nps_score_above_100", "city_unknown"),
        ("purchase_frequency_below_0", "total_spent_below_0", "last_purchase_days_below_0"),
        ("gender_unknown",),
    }
    valid, rejected = quality.split_valid(edge_rows(spark))
    assert (valid.count(), rejected.count()) == (10, 3)
    assert valid.columns == edge_rows(spark).columns and "violations" in rejected.columns
    assert quality.with_violations(edge_rows(spark), {}, {}).filter("is_valid").count() == 13


def test_undefined_scores_are_flagged(spark):
    flags = {r[KEY]: r["score_flags"] for r in quality.with_quality_flags(edge_rows(spark)).collect()}
    assert flags["c09"] == ["recency_undefined", "frequency_undefined", "monetary_undefined"]
    assert flags["c10"] == []


def test_defaults_replace_missing_values_only(spark):
    blank = edge_rows(spark, [{c: None for c in DEFAULTS} | {"returns_count": None}, {}])
    filled, usual = quality.fill_defaults(blank).collect()
    assert {c: filled[c] for c in DEFAULTS} == DEFAULTS
    assert filled["returns_count"] is None
    assert usual["age"] == 40


def test_split_is_complete_disjoint_and_stable(spark, customer_rows):
    train, test = split.split(customer_rows)
    n = customer_rows.count()
    assert train.count() + test.count() == n
    assert 0.76 * n < train.count() < 0.84 * n
    keys = {r[KEY] for r in train.select(KEY).collect()}
    assert not keys & {r[KEY] for r in test.select(KEY).collect()}
    for other in (customer_rows.repartition(3), customer_rows.orderBy(F.desc("age")), customer_rows.coalesce(1)):
        assert {r[KEY] for r in split.split(other)[0].select(KEY).collect()} == keys
    assert {r[KEY] for r in split.split(customer_rows, seed=7)[0].select(KEY).collect()} != keys


def test_names_with_dots_and_names_in_use(spark):
    rows = edge_rows(spark).withColumns({"a.b": F.lit(float("nan")), "text0": F.lit("t"), "salt": F.lit("s")})
    assert explore.kpi_summary(rows).first()["total_columns"] == len(rows.columns)
    valid, rejected = quality.split_valid(rows.withColumn("is_valid", F.lit("own")))
    assert {r["is_valid"] for r in [*valid.collect(), *rejected.collect()]} == {"own"}
    with pytest.raises(ValueError, match="violations"):
        quality.with_violations(rows.withColumn("violations", F.lit(1)))
    for most in (0, 10):
        fitted = encoding.fit_encoding(rows, ["gender", "city"], max_in_memory=most)
        for df in (fitted.transform(rows), fitted.transform(fitted.transform(rows))):
            assert df.columns == [*rows.columns, *[c for c in df.columns if c.endswith("_encoded")]]
            assert {(r["text0"], r["salt"]) for r in df.collect()} == {("t", "s")}
            assert all((r["gender"] == "F") == (r["gender_encoded"] == 0) for r in df.collect())
