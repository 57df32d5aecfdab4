"""Label encoding: a category's rank among the sorted distinct values, from 0.

Up to ``max_in_memory`` distinct labels are held by the driver and applied
inside the scan's stage, by Spark ML's indexer or, where handing it the labels
would take long, by a join with them. A column with more is ranked by a
distributed sort, kept as a table and applied by a join that keeps frequent
labels out of the way, so neither path needs the labels of a large column, or
the rows of a frequent label, in one place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custspark.functions.missing import category, exact
from custspark.schema import CATEGORICALS
from custspark.session import materialise

MAX_IN_MEMORY = 100_000
MAX_INDEXER_LABELS = 1_000
HOT_SHARE = 1000
SALTS = 1024
UNSEEN = -1
LABEL_SCHEMA = "column string, label string, idx bigint"


def label_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, label, n) of all columns in one pass; repeats collapse before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), category(c).alias("label")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("column", "label").agg(F.count(F.lit(1)).alias("n"))


def rank_labels(labels: DataFrame) -> DataFrame:
    """Add ``idx`` to distinct ``label``s: the rank in sort order, without one task seeing all.

    Labels are range-partitioned and numbered in order; a label's rank is its
    number in its partition plus the sizes of the partitions before. The numbers
    are written, because the ranges' sampled bounds may differ in another run of
    the same plan; nothing is shuffled a second time.
    """
    ordered = labels.repartitionByRange("label").sortWithinPartitions("label")
    numbered = materialise(ordered.withColumn("number", F.monotonically_increasing_id()), "label-ranges")
    # The number holds the partition in its upper bits, and the place in it in the lower 33.
    placed = numbered.withColumns(
        {"part": F.shiftright("number", 33), "inside": F.col("number").bitwiseAND((1 << 33) - 1)}
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, so both the window and the broadcast have at most as many rows as partitions.
    offsets = (
        placed.groupBy("part")
        .agg(F.count(F.lit(1)).alias("size"))
        .select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "part")
        .withColumn("idx", F.col("offset") + F.col("inside"))
        .drop("number", "part", "inside", "offset")
    )


def _packed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows as the struct ``row``, so that no name of theirs can clash, and the columns' texts as text0, text1, ..."""
    texts = [category(exact(c)).alias(f"text{i}") for i, c in enumerate(columns)]
    return df.select(F.struct(*[exact(c) for c in df.columns]).alias("row"), *texts)


def _unpacked(packed: DataFrame, df: DataFrame, encoded: dict[str, Column]) -> DataFrame:
    """The columns of ``df`` and the encoded ones; earlier encodings of the same columns are replaced."""
    new = {f"{c}_encoded": index for c, index in encoded.items()}
    own = [F.col("row").getField(c).alias(c) for c in df.columns if c not in new]
    return packed.select(*own, *[index.alias(c) for c, index in new.items()])


def _met(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """The packed rows with ``hot_idx`` or ``idx`` from a (label, idx, is_hot) table; both NULL for an unknown label.

    Frequent labels come by a broadcast of fewer than ``HOT_SHARE`` rows, the others by a
    shuffle. A row with a frequent label has its index before the shuffle; its salt,
    which matches nothing, only spreads it over the tasks. The input
    partition is part of the salt, so that copies are spread as well; it is
    the same when a task runs again.
    """
    hot = table.filter("is_hot").select(F.col("label").alias("hot_label"), F.col("idx").alias("hot_idx"))
    cold = table.filter("not is_hot").select("label", "idx", F.lit(0).alias("label_salt"))
    salt = (F.pmod(F.xxhash64(F.spark_partition_id(), "row"), F.lit(SALTS)) + 1).cast("int")
    rows = (
        _packed(df, [column])
        .join(F.broadcast(hot), F.col("text0") == F.col("hot_label"), "left")
        .withColumn("salt", F.when(F.col("hot_idx").isNotNull(), salt).otherwise(F.lit(0)))
    )
    return rows.join(cold, (F.col("text0") == F.col("label")) & (F.col("salt") == F.col("label_salt")), "left")


@dataclass(frozen=True)
class CategoryEncoding:
    """Fitted encoding; every fit makes a new one.

    ``labels`` holds the sorted labels of small columns. ``tables`` holds
    (label, idx, is_hot) for large ones.
    """

    labels: dict[str, list[str]]
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [*self.labels, *self.tables]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``<column>_encoded``; a label that was not there at fit time becomes -1."""
        for column, table in self.tables.items():
            df = self._join(df, column, table)
        names = [c for c, labels in self.labels.items() if len(labels) <= MAX_INDEXER_LABELS]
        for column in self.labels:
            if column not in names:
                df = self._lookup(df, column)
        return self._index(df, names) if names else df

    def _lookup(self, df: DataFrame, column: str) -> DataFrame:
        """By a join with the labels; whether they are broadcast is decided by their size in bytes."""
        table = df.sparkSession.createDataFrame(list(enumerate(self.labels[column])), "idx bigint, label string")
        joined = _packed(df, [column]).join(table, F.col("text0") == F.col("label"), "left")
        return _unpacked(joined, df, {column: F.coalesce("idx", F.lit(UNSEEN).cast("bigint"))})

    def _index(self, df: DataFrame, names: list[str]) -> DataFrame:
        """By Spark ML's indexer."""
        places = range(len(names))
        # "keep" gives every unknown label the index behind the last one.
        model = StringIndexerModel.from_arrays_of_labels(
            [self.labels[c] for c in names],
            inputCols=[f"text{i}" for i in places],
            outputCols=[f"index{i}" for i in places],
            handleInvalid="keep",
        )
        indexed = model.transform(_packed(df, names))
        return _unpacked(
            indexed,
            df,
            {
                c: F.when(F.col(f"index{i}") < len(self.labels[c]), F.col(f"index{i}").cast("bigint")).otherwise(F.lit(UNSEEN))
                for i, c in enumerate(names)
            },
        )

    @staticmethod
    def _join(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
        return _unpacked(_met(df, column, table), df, {column: F.coalesce("hot_idx", "idx", F.lit(UNSEEN).cast("bigint"))})

    def save(self, path: str, spark: SparkSession) -> None:
        rows = [(c, label, i) for c, labels in self.labels.items() for i, label in enumerate(labels)]
        spark.createDataFrame(rows, LABEL_SCHEMA).write.mode("overwrite").parquet(f"{path}/in_memory")
        spark.createDataFrame([(c,) for c in self.tables], "column string").write.mode("overwrite").parquet(
            f"{path}/table_names"
        )
        for column, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/table_{column}")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> CategoryEncoding:
        labels: dict[str, list[str]] = {}
        for row in spark.read.parquet(f"{path}/in_memory").orderBy("column", "idx").collect():
            labels.setdefault(row["column"], []).append(row["label"])
        names = [row["column"] for row in spark.read.parquet(f"{path}/table_names").collect()]
        return cls(labels, {c: spark.read.parquet(f"{path}/table_{c}") for c in names})


def fit_encoding(
    df: DataFrame, columns: list[str] | None = None, max_in_memory: int = MAX_IN_MEMORY
) -> CategoryEncoding:
    """Fit all columns at once; ``max_in_memory`` bounds the labels of all columns the driver may hold."""
    columns = CATEGORICALS if columns is None else columns
    counts = label_counts(df, columns)
    # At most one row beyond the bound reaches the driver.
    found = counts.select("column", "label").limit(max_in_memory + 1).collect()
    if len(found) <= max_in_memory:
        return CategoryEncoding(_sorted_labels(found, columns))
    counts = materialise(counts, "labels")
    sizes = {
        row["column"]: row
        for row in counts.groupBy("column").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows")).collect()
    }
    large = [c for c in columns if c in sizes and sizes[c]["labels"] > max_in_memory // len(columns)]
    small = counts.filter(~F.col("column").isin(large)).select("column", "label").collect()
    tables = {}
    for c in large:
        ranked = rank_labels(counts.filter(F.col("column") == c).select("label", "n"))
        is_hot = F.col("n") * HOT_SHARE > sizes[c]["rows"]
        tables[c] = materialise(ranked.select("label", "idx", is_hot.alias("is_hot")), "label-ranks")
    return CategoryEncoding(_sorted_labels(small, [c for c in columns if c not in large]), tables)


def _sorted_labels(pairs: list, columns: list[str]) -> dict[str, list[str]]:
    return {c: sorted(label for column, label in pairs if column == c) for c in columns}


#: Sorted class labels, or (label, idx, is_hot) where there are more than the driver may hold.
ClassLabels = list[str] | DataFrame


def fit_segment_labels(df: DataFrame, column: str = "segment", max_in_memory: int = MAX_IN_MEMORY) -> ClassLabels:
    """The class labels, however many: a forest holds a count for each class anyway."""
    fitted = fit_encoding(df.filter(F.col(column).isNotNull()), [column], max_in_memory)
    return _class_labels(fitted, column)


def fit_encoding_and_segments(
    df: DataFrame, column: str = "segment", max_in_memory: int = MAX_IN_MEMORY
) -> tuple[CategoryEncoding, ClassLabels]:
    """Categories and class labels in one pass over the data."""
    fitted = fit_encoding(df, [*CATEGORICALS, column], max_in_memory)
    labels = {c: values for c, values in fitted.labels.items() if c != column}
    tables = {c: table for c, table in fitted.tables.items() if c != column}
    return CategoryEncoding(labels, tables), _class_labels(fitted, column)


def _class_labels(fitted: CategoryEncoding, column: str) -> ClassLabels:
    return fitted.labels[column] if column in fitted.labels else fitted.tables[column]


def encode_segment(df: DataFrame, labels: ClassLabels, column: str = "segment", skip: bool = False) -> DataFrame:
    """Add ``segment_label``; a missing or unknown segment stops the job, or its row is left out with ``skip``.

    The number of classes goes with the column. Labels in a table meet the rows in a join, as large categories do.
    """
    if isinstance(labels, list):
        model = StringIndexerModel.from_labels(
            labels, inputCol=column, outputCol="segment_label", handleInvalid="skip" if skip else "error"
        )
        return model.transform(df)
    met = _met(df, column, labels)
    index = F.when(F.col("row").getField(column).isNotNull(), F.coalesce("hot_idx", "idx")).cast("double")
    if skip:
        met = met.filter(index.isNotNull())
    else:
        told = F.concat(F.lit("NULL or unseen label: "), F.col("text0"))
        index = F.coalesce(index, F.raise_error(told).cast("double"))
    own = [F.col("row").getField(c).alias(c) for c in df.columns]
    classes = {"ml_attr": {"type": "nominal", "name": "segment_label", "num_vals": labels.count()}}
    return met.select(*own, index.alias("segment_label", metadata=classes))


def decode_segment(df: DataFrame, labels: ClassLabels, input_column: str, output_column: str) -> DataFrame:
    """Add the label of each class; Spark decides by its size whether a table of labels is broadcast."""
    if isinstance(labels, list):
        return IndexToString(inputCol=input_column, outputCol=output_column, labels=labels).transform(df)
    row = F.struct(*[exact(c) for c in df.columns])
    packed = df.select(row.alias("row"), exact(input_column).cast("bigint").alias("class"))
    met = packed.join(labels.select("idx", "label"), F.col("class") == F.col("idx"), "left")
    return met.select(*[F.col("row").getField(c).alias(c) for c in df.columns], F.col("label").alias(output_column))
