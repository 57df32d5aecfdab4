"""Helpers that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that cross to Python at once: a batch of long texts must fit a worker.
BATCH_ROWS = 500

#: A-Z to a-z, other bytes unchanged.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

Measure = Callable[[pa.Array, pa.Array], Sequence[pa.Array]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name; a missing one is an error here and not later."""
    if name not in df.columns:
        raise ValueError(f"column {name} is missing; there are {', '.join(df.columns)}")
    return F.col(f"`{name}`")


def prepare(spark: SparkSession) -> None:
    """Bound what crosses to Python at once, and let Python workers find this package.

    A smaller batch setting of the caller stays. The package's folder helps where the
    machines share it; elsewhere the package is installed or given with --py-files.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Give freed memory back to the system: workers live on from task to task, and share an executor with its heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep theirs
        ctypes.CDLL(None).malloc_trim(0)


def released(batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same function on batches, with memory given back at a task's end."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from batches(rows)
        finally:
            release()

    return run


def raw_texts(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def extend(
    docs: DataFrame,
    start: Callable[[], Measure],
    fields: str,
    keep: Sequence[str],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Columns ``keep`` as the struct ``row``, and the columns ``fields`` that a task computes.

    ``start`` runs once in a task and gives a function from the batch's ids and
    texts to one array per field. The struct keeps columns of the input from
    clashing with the new ones.
    """
    prepare(docs.sparkSession)
    # A text that is kept crosses to Python once, in its row.
    inside = text_col in keep and docs.schema[text_col].dataType == T.StringType()
    packed = docs.select(
        F.struct(*[column(docs, c) for c in keep]).alias("row") if keep else F.lit(0).alias("row"),
        column(docs, id_col).alias("id"),
        *([] if inside else [column(docs, text_col).cast("string").alias("text")]),
    )
    added = T._parse_datatype_string(fields)
    schema = T.StructType([packed.schema["row"], *added.fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = start()
        for batch in batches:
            if batch.num_rows:
                texts = batch.column("row").field(text_col) if inside else batch.column("text")
                arrays = measure(batch.column("id"), texts)
                yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], names=names)

    return packed.mapInArrow(released(run), schema)


def emit(
    docs: DataFrame,
    start: Callable[[], Callable[[pa.Array, pa.Array], Iterator[dict[str, pa.Array]]]],
    schema: str,
    id_col: str | None = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Any number of rows for each batch of ids and texts."""
    prepare(docs.sparkSession)
    ids = column(docs, id_col) if id_col else F.lit(0)
    fed = docs.select(ids.alias("id"), column(docs, text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            if batch.num_rows:
                for arrays in each(batch.column("id"), batch.column("text")):
                    yield pa.RecordBatch.from_pydict(arrays)

    return fed.mapInArrow(released(run), schema)


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Windows:
    """64-bit hashes of runs of k consecutive words, from the words' hashes.

    A polynomial in an odd base modulo 2**64: differences of prefix sums, divided
    by the base's power (which has an inverse), then mixed.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self._size = 0
        self._grow(1 << 15)

    def _grow(self, size: int) -> None:
        inverse = pow(self.BASE, -1, 1 << 64)
        self._powers, self._inverse = np.ones(size + 1, np.uint64), np.ones(size + 1, np.uint64)
        np.cumprod(np.full(size, self.BASE, np.uint64), out=self._powers[1:])
        np.cumprod(np.full(size, inverse, np.uint64), out=self._inverse[1:])
        self._size = size

    def of(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """The windows' hashes in order of their start; none if there are fewer than k words."""
        n = len(hashes)
        if n < k:
            return np.empty(0, np.uint64)
        return self.spans(hashes, np.arange(n - k + 1), np.arange(k, n + 1))

    def spans(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of words starts[i] to ends[i], exclusive."""
        n = len(hashes)
        if n > self._size:
            self._grow(2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self._powers[:n], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's bigint."""
    return x.view(np.int64)
