"""Read customers from CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custspark.functions.missing import text_or_null
from custspark.schema import CUSTOMER_SCHEMA
from custspark.sources.inference import with_inferred_types
from custspark.sources.quoted import records


class LoadError(RuntimeError):
    """A source could not be read; the message names the location."""


def _whole_number(text: Column) -> Column:
    """A bigint; a column with missing cells is often written as ``5.0``, which counts as 5."""
    value = text.try_cast("double")
    return F.coalesce(text.try_cast("bigint"), F.when(value == F.floor(value), value.try_cast("bigint")))


def _typed(name: str, data_type: T.DataType, on_bad_cell: str, fractions: str) -> Column:
    text = text_or_null(F.col(f"`{name}`"))
    if isinstance(data_type, T.StringType):
        return text.alias(name)
    trimmed = F.trim(text)
    if fractions == "keep" and isinstance(data_type, T.LongType):
        data_type = T.DoubleType()
    if isinstance(data_type, T.LongType):
        value = _whole_number(trimmed)
    else:
        value = F.nanvl(trimmed.try_cast(data_type), F.lit(None))
    if on_bad_cell == "fail":
        message = F.concat(F.lit(f"column {name}: not a {data_type.simpleString()}: "), text)
        value = F.when(value.isNull() & text.isNotNull(), F.raise_error(message).cast(data_type)).otherwise(value)
    return value.alias(name)


FORMAT = {"quote": '"', "escape": '"'}  # a quote inside quotes is doubled
MALFORMED = "_malformed"


def _complete_lines(raw: DataFrame, names: list[str]) -> DataFrame:
    """Stop at a line with more cells than the header, whose cells may be shifted.

    Only lines that Spark marks as malformed are parsed a second time. A line
    with fewer cells ends in missing ones.
    """
    cells = ", ".join(f"`{n}` string" for n in [*names, "_surplus"])
    surplus = F.from_csv(MALFORMED, F.lit(cells), FORMAT).getField("_surplus")
    message = F.concat(F.lit("more cells than columns: "), F.col(MALFORMED))
    too_long = F.when(F.col(MALFORMED).isNotNull() & surplus.isNotNull(), F.raise_error(message).cast("boolean"))
    return raw.filter(too_long.otherwise(F.lit(True)))


def _stitched(spark: SparkSession, path: str | list[str], names: list[str]) -> DataFrame | None:
    """The cells of files that have line breaks inside quotes; None if there are none."""
    first = spark.read.text(path, lineSep="\n").limit(1).collect()
    # Lines that end in a carriage return alone are all one line to the reader above.
    line_sep = "\r" if first and "\r" in first[0]["value"].rstrip("\r") else "\n"
    found = records(spark, path, line_sep)
    if not found.broken:
        return None
    if found.unclosed:
        raise LoadError(f"cannot load customers: quotes are never closed in {', '.join(found.unclosed)}")
    if len({h.strip('\ufeff\r').replace('"', "") for h in found.headers}) > 1:
        raise LoadError(f"cannot load customers: files with different headers: {found.headers}")
    cells = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    parsed = F.from_csv("value", F.lit(cells), {**FORMAT, "multiLine": "true"})
    rows = found.read().select("value", "whole", parsed.alias("cells"))
    surplus = F.col("cells").getField(f"c{len(names)}")
    message = F.concat(F.lit("more cells than columns: "), F.col("value"))
    too_long = F.when(F.col("whole") & surplus.isNotNull(), F.raise_error(message).cast("boolean"))
    checked = rows.filter(too_long.otherwise(F.lit(True)))
    return checked.select(*[F.col("cells").getField(f"c{i}").alias(n) for i, n in enumerate(names)])


def read_customers_csv(
    spark: SparkSession,
    path: str | list[str],
    required: T.StructType = CUSTOMER_SCHEMA,
    on_bad_cell: str = "fail",
    fractions: str = "fail",
    multi_line: bool = False,
    further: str = "text",
) -> DataFrame:
    """Customers from one or more CSV files with a header row.

    ``path`` is any location Spark can read. Columns are matched by name, typed
    by the customer schema (no inference pass over the data), and cells that
    stand for "missing" become NULL. A cell that is no number where one is
    required stops the job that reads it, or becomes NULL with
    ``on_bad_cell="null"``; a line with too many cells always does. A fraction in a
    whole-number column is such a cell, unless ``fractions="keep"`` reads all those
    columns as doubles. Further
    columns are kept behind the known ones as text; ``further="infer"`` looks at all their cells
    when this function is called and gives them the narrowest type that holds all. Files with another header
    than the first are refused.

    Line breaks inside quotes are read as part of their cell. To find them all lines are looked at
    when this function is called; a large file is read by many tasks all the same. ``multi_line`` leaves
    that to Spark's reader, at the price of one task per file.
    """
    if on_bad_cell not in ("fail", "null"):
        raise ValueError("on_bad_cell is 'fail' or 'null'")
    if fractions not in ("fail", "keep"):
        raise ValueError("fractions is 'fail' or 'keep'")
    if further not in ("text", "infer"):
        raise ValueError("further is 'text' or 'infer'")
    options = {"header": True, "multiLine": multi_line, **FORMAT}
    try:
        header = spark.read.csv(path, inferSchema=False, **options).schema.names
        names = [n.removeprefix("\ufeff") for n in header]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*header, MALFORMED]])
        # Without all cells parsed, a shifted line would go unnoticed in a query on few columns.
        raw = (
            spark.read.option("columnPruning", False)
            .schema(schema)
            .csv(path, enforceSchema=False, columnNameOfCorruptRecord=MALFORMED, **options)
        )
    except Exception as error:
        raise LoadError(f"cannot load customers from {path}: {error}") from error
    missing = [f.name for f in required if f.name not in names]
    if missing:
        raise LoadError(f"cannot load customers from {path}: columns missing: {', '.join(missing)}")
    stitched = None if multi_line else _stitched(spark, path, names)
    rows = _complete_lines(raw, header).toDF(*names, MALFORMED) if stitched is None else stitched
    known = [_typed(f.name, f.dataType, on_bad_cell, fractions) for f in required]
    others = [c for c in names if c not in required.names]
    found = rows.select(*known, *[text_or_null(F.col(f"`{c}`")).alias(c) for c in others])
    return with_inferred_types(found, others) if further == "infer" else found


def preview_csv(spark: SparkSession, path: str | list[str], n: int = 10, **options) -> DataFrame:
    """The first ``n`` customers in the order of the files' names and of the lines in them.

    Files are opened one after another until there are enough rows, and read from their start no
    further than that. ``n`` rows are held by the driver. Options as of ``read_customers_csv``.
    """
    required = options.get("required", CUSTOMER_SCHEMA)
    rows, schema = [], required
    for file in sorted(spark.read.text(path).inputFiles()):
        # With one task a file and its lines in order, a limit ends the reading.
        first = read_customers_csv(spark, file, **{**options, "multi_line": True}).limit(n - len(rows))
        rows, schema = [*rows, *first.collect()], first.schema
        if len(rows) >= n:
            break
    return spark.createDataFrame(rows, schema)


def write_customers_csv(df: DataFrame, path: str) -> None:
    """One CSV folder with a header in every file."""
    df.write.mode("overwrite").csv(path, header=True, **FORMAT)
