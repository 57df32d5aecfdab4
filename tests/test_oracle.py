"""Every query with SQL gives the same columns, types and values as DuckDB."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from custspark.plans.oracle import ORACLE
from custspark.plans.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{data_dir}/{name}.parquet'")
    return con


DUCK_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _cells(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(row[i] for i in order) for row in rows], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, data_dir, name):
    df = queries()[name](spark, data_dir)
    got = _cells(df.columns, df.collect())
    result = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = _cells(columns, result.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert {c: DUCK_TYPES[t] for c, t in df.dtypes} == {d[0]: str(d[1]) for d in result.description}
    assert len(got) == len(want) > 0
    wrong = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    assert not wrong, (len(wrong), wrong[:3])


def test_only_models_have_no_sql():
    assert set(QUERIES) - set(ORACLE) == {"train_metrics", "train_metrics_small", "score_customers"}
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert [r["segment"] for r in rows] == sorted(r["segment"] for r in rows)
    assert rows
