"""CSV records over several lines and blocks, against Python's own reader."""

import csv
import io
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from custspark.sources import quoted
from custspark.sources.csv import LoadError, read_customers_csv

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("customer_id", "city", "segment")])


@pytest.fixture
def split_bytes(spark):
    """Sets the size of a file's splits."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, before)


def _cells(rng):
    pieces = ["a", "Dha", "ka", " x", "é", "日本", "😀", "1"]
    special = ["\n", "\n\n", "\r\n", '"', '""', ",", '",', '"\n', ',"\n"', "\n,"]
    kind = rng.random()
    if kind < 0.5:
        return rng.choice(pieces) + rng.choice(pieces)
    return rng.choice(pieces) + "".join(rng.choice(pieces + special) for _ in range(rng.randrange(12))) + rng.choice(pieces)


def _written(path, rows, end="\n", always=False):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL if always else csv.QUOTE_MINIMAL).writerows([SCHEMA.names, *rows])
    path.write_bytes(out.getvalue().encode())
    return str(path)


@pytest.mark.parametrize("seed,size,end,always", [(1, 97, "\n", False), (2, 150, "\r\n", False), (3, 301, "\n", True), (4, 10**6, "\n", False)])
def test_records_equal_pythons_reader(spark, tmp_path, split_bytes, seed, size, end, always):
    rng = random.Random(seed)
    rows = [[f"c{i}", _cells(rng), _cells(rng)] for i in range(40)]
    # One record is longer than many blocks.
    rows.insert(20, ["long", "line\n" * 80 + "end", 'he said ""\n""'])
    paths = [_written(tmp_path / "a.csv", rows[:30], end, always), _written(tmp_path / "b.csv", rows[30:], end, always)]
    split_bytes(size)
    got = read_customers_csv(spark, paths, SCHEMA)
    assert sorted(map(list, got.collect())) == sorted(rows)
    if size < 10**6:
        assert spark.read.text(paths).rdd.getNumPartitions() > 4


def test_a_broken_city_is_one_customer(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('customer_id,city,segment\nc1,"Dha\nka",Regular\n\nc2,5" pipe,"New" x\nc3,"a ""b\n"" c"\n')
    rows = {tuple(r) for r in read_customers_csv(spark, str(path), SCHEMA).collect()}
    assert {r[:2] for r in rows} == {("c1", "Dha\nka"), ("c2", '5" pipe'), ("c3", 'a "b\n" c')}
    assert len(rows) == 3


def test_quotes_inside_a_cell_open_nothing(spark, tmp_path, split_bytes):
    """As many as there are, a quote that is not a cell's first character is a character."""
    path = tmp_path / "a.csv"
    lines = [f'c{i},5" pipe,x{i}' for i in range(21)]
    path.write_text("\n".join(["customer_id,city,segment", *lines, 'z,"two\nlines",end']) + "\n")
    split_bytes(40)
    rows = sorted(map(tuple, read_customers_csv(spark, str(path), SCHEMA).collect()))
    assert len(rows) == 22 and rows[-1] == ("z", "two\nlines", "end") and all(r[1] == '5" pipe' for r in rows[:-1])


def test_errors(spark, tmp_path, split_bytes):
    head = "customer_id,city,segment\n"
    path = tmp_path / "open.csv"
    path.write_text(head + 'c1,"never closed,x\nc2,y,z\n')
    with pytest.raises(LoadError, match="never closed in .*open.csv"):
        read_customers_csv(spark, str(path), SCHEMA)
    path = tmp_path / "long.csv"
    path.write_text(head + 'c1,"a\nb",x,surplus\n')
    with pytest.raises(PySparkException, match="more cells than columns"):
        read_customers_csv(spark, str(path), SCHEMA).select("city").collect()
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text(head + 'c1,"a\nb",x\n')
    b.write_text("city,customer_id,segment\nc1,a,x\n")
    with pytest.raises(LoadError, match="different headers"):
        read_customers_csv(spark, [str(a), str(b)], SCHEMA)
    a.write_text(head + 'c1,"a\nb",x\n' * 30)
    split_bytes(50)
    late = read_customers_csv(spark, str(a), SCHEMA)
    split_bytes(33)
    with pytest.raises(PySparkException, match="splits have changed"):
        late.collect()


def test_only_lines_of_broken_records_are_shuffled(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("customer_id,city,segment\n" + "".join(f"c{i},x,y\n" for i in range(50)) + 'z,"a\nb",c\n')
    found = quoted.records(spark, str(path))
    assert found.broken and found.unclosed == []
    plan = found.read()._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "SortMergeJoin" not in plan
