import pytest
from edge import edge_rows
from pyspark.errors import PySparkException

from custspark.operators import quality
from custspark.schema import CUSTOMER_SCHEMA
from custspark.sources import csv, tables

NAMES = CUSTOMER_SCHEMA.names


def write(path, header, *lines):
    path.write_text("\n".join([",".join(header), *lines]) + "\n", encoding="utf-8")
    return str(path)


def line(**cells):
    usual = {"customer_id": "c1", "segment": "Regular", "registration_date": "2024-01-01", "gender": "F"}
    usual |= {"city": "Dhaka"}
    usual |= {"favorite_category": "Fashion", "preferred_channel": "Website", "device_type": "Mobile"}
    return ",".join(str(cells.get(c, usual.get(c, 1))) for c in NAMES)


def test_missing_cells_are_null(spark, tmp_path):
    cells = ["NA", "None", "nan", "", "NULL", '""', "#N/A", "<NA>"]
    lines = [line(customer_id=f"c{i}", age=c, total_spent=c, city=c) for i, c in enumerate(cells)]
    path = write(tmp_path / "a.csv", NAMES, *lines)
    rows = csv.read_customers_csv(spark, path).collect()
    assert len(rows) == len(cells)
    assert {(r["age"], r["total_spent"], r["city"]) for r in rows} == {(None, None, None)}


def test_columns_are_matched_by_name_and_further_ones_kept(spark, tmp_path):
    header = ["note", *reversed(NAMES)]
    path = write(tmp_path / "a.csv", header, '"say ""hi"", now",' + ",".join(reversed(line(age="33").split(","))))
    df = csv.read_customers_csv(spark, path)
    assert df.columns == [*NAMES, "note"]
    row = df.first()
    assert (row["customer_id"], row["age"], row["note"]) == ("c1", 33, 'say "hi", now')
    assert dict(df.dtypes) == {**{f.name: f.dataType.simpleString() for f in CUSTOMER_SCHEMA}, "note": "string"}


def test_whole_numbers_written_as_floats(spark, tmp_path):
    path = write(tmp_path / "a.csv", NAMES, line(age="5.0", nps_score="-3", session_count="9007199254740993"))
    row = csv.read_customers_csv(spark, path).first()
    assert (row["age"], row["nps_score"], row["session_count"]) == (5, -3, 9007199254740993)


@pytest.mark.parametrize("cell", ["abc", "5.5"])
def test_bad_cells(spark, tmp_path, cell):
    path = write(tmp_path / "a.csv", NAMES, line(age=cell))
    with pytest.raises(PySparkException, match=f"column age: not a bigint: {cell}"):
        csv.read_customers_csv(spark, path).collect()
    assert csv.read_customers_csv(spark, path, on_bad_cell="null").first()["age"] is None


def test_errors_name_the_location(spark, tmp_path):
    with pytest.raises(csv.LoadError, match="nowhere.csv"):
        csv.read_customers_csv(spark, str(tmp_path / "nowhere.csv"))
    path = write(tmp_path / "a.csv", ["customer_id", "segment"], "c1,Regular")
    with pytest.raises(csv.LoadError, match="columns missing: registration_date"):
        csv.read_customers_csv(spark, path)


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path / "a.csv", NAMES, line(city='"New\nYork"'))
    assert csv.read_customers_csv(spark, path, multi_line=True).first()["city"] == "New\nYork"


def test_long_and_short_lines(spark, tmp_path):
    path = write(tmp_path / "a.csv", NAMES, line(), line(customer_id="c2", city='"New, York"'), "c3,Regular")
    rows = {r["customer_id"]: r for r in csv.read_customers_csv(spark, path).collect()}
    assert (rows["c2"]["city"], rows["c3"]["segment"], rows["c3"]["age"]) == ("New, York", "Regular", None)
    path = write(tmp_path / "b.csv", NAMES, line(), line(city="New, York"))
    with pytest.raises(PySparkException, match="more cells than columns"):
        csv.read_customers_csv(spark, path).collect()
    with pytest.raises(PySparkException, match="more cells than columns"):
        csv.read_customers_csv(spark, path).select("customer_id").collect()


def test_byte_order_mark(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["\ufeffcustomer_id", *NAMES[1:]], line())
    assert csv.read_customers_csv(spark, path).first()["customer_id"] == "c1"


def test_files_with_another_header_are_refused(spark, tmp_path):
    a = write(tmp_path / "a.csv", NAMES, line())
    b = write(tmp_path / "b.csv", [NAMES[1], NAMES[0], *NAMES[2:]], line())
    with pytest.raises(Exception, match="header"):
        csv.read_customers_csv(spark, [a, b]).collect()


def test_several_files(spark, tmp_path):
    paths = [write(tmp_path / f"{i}.csv", NAMES, line(customer_id=f"c{i}")) for i in range(3)]
    assert {r["customer_id"] for r in csv.read_customers_csv(spark, paths).collect()} == {"c0", "c1", "c2"}


def test_table_is_created_once_and_replaced_on_save(spark):
    tables.create_table(spark, "shop")
    assert spark.table("shop").columns == NAMES
    assert tables.load_table(spark, "shop").count() == 0
    tables.save_table(edge_rows(spark), "shop")
    tables.create_table(spark, "shop")
    assert tables.load_table(spark, "shop").count() == 13
    tables.save_table(edge_rows(spark).select("customer_id", "age").limit(2), "shop")
    again = tables.load_table(spark, "shop")
    assert (again.columns, again.count()) == (["customer_id", "age"], 2)


@pytest.mark.parametrize("external", [False, True])
def test_table_is_replaced_by_rows_made_from_itself(spark, tmp_path, external):
    name, path = f"own_{external}".lower(), str(tmp_path / "t") if external else None
    tables.save_table(edge_rows(spark), name, path)
    tables.save_table(quality.fill_defaults(tables.load_table(spark, name)).filter("age > 17"), name, path)
    assert tables.load_table(spark, name).count() == 12
    with pytest.raises(PySparkException):
        tables.save_table(edge_rows(spark), "no_such_database.t")


def test_key_checks(spark):
    df = edge_rows(spark).union(edge_rows(spark, [{"customer_id": None}]))
    assert [tuple(r) for r in tables.duplicate_keys(df).collect()] == [("c11", 2)]
    assert tuple(tables.key_report(df).first()) == (14, 12, 1, 1)
    assert tuple(tables.key_report(df.limit(0)).first()) == (0, 0, 0, 0)
