"""CSV records whose quoted cells hold line breaks, from files that many tasks read.

A task that reads a block in the middle of a file can't tell whether its first line is a record's
beginning or goes on inside a quoted cell. So each block is read once for either case. What a line does
to both cases is one of four functions; what a block does is their composition, one summary row. A
prefix over a file's summary rows tells each block its case, and the lines of records that go over several
lines, or over a block's end, are put together again. All other lines are never moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custspark.session import materialise

_QUOTED = r'(?:[^"]++|"")*+'
_FIELDS = rf'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+'
#: A line that ends inside quotes, if it begins outside of them; the same if it begins inside.
OPENS = rf'\A{_FIELDS}"{_QUOTED}\z'
STAYS = rf'\A{_QUOTED}(?:"[^,]*+,{_FIELDS}"{_QUOTED})?+\z'
#: What a line without quotes does: outside stays outside (bit 0 unset), inside stays inside (bit 1 set).
UNCHANGED = 2

BLOCK = ["file", "block"]
PARSED = "file string, block bigint, length bigint, seq bigint, start0 bigint, start1 bigint, ends int, value string"


def _lines(spark: SparkSession, path: str | list[str], line_sep: str) -> DataFrame:
    """file, block, length, does (the line's function), value: the lines in their order inside a block."""
    value = F.col("value")
    does = F.when(F.contains(value, F.lit('"')), value.rlike(OPENS).cast("int") + 2 * value.rlike(STAYS).cast("int"))
    return spark.read.text(path, lineSep=line_sep).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"),
        F.coalesce(does, F.lit(UNCHANGED)).alias("does"),
        "value",
    )


class _Block:
    """The state of one block while its lines are read: for both cases, the case now and the last record's first line."""

    def __init__(self) -> None:
        self.seq, self.now, self.start = 0, [0, 1], [-1, -1]

    def read(self, does: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Of the next lines: their numbers, the first line of their record (-1: in a block before) and how they end."""
        n = len(does)
        seq = np.arange(self.seq, self.seq + n)
        change = np.flatnonzero(does != UNCHANGED).tolist()
        inside = np.empty((2, n + 1), np.int8)
        for case in (0, 1):
            now, at = self.now[case], 0
            for i in change:
                inside[case, at : i + 1] = now
                now, at = int(does[i]) >> now & 1, i + 1
            inside[case, at:] = now
            self.now[case] = now
        starts = []
        for case in (0, 1):
            first = np.maximum.accumulate(np.where(inside[case, :n] == 0, seq, self.start[case]))
            self.start[case] = int(first[-1])
            starts.append(first)
        self.seq += n
        return seq, starts, inside[0, 1:] + 2 * inside[1, 1:]


def _parsed(lines: DataFrame) -> DataFrame:
    """The lines with their number in the block, and for both cases their record's first line and their end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, _Block()
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column("place").to_numpy()
            for part in np.split(np.arange(len(place)), np.flatnonzero(np.diff(place)) + 1):
                lo, hi = int(part[0]), int(part[-1]) + 1
                own = (batch.column("file")[lo].as_py(), batch.column("block")[lo].as_py())
                if own != key:
                    key, block = own, _Block()
                seq, starts, ends = block.read(batch.column("does").to_numpy()[lo:hi])
                piece = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("file"),
                        piece.column("block"),
                        piece.column("length"),
                        pa.array(seq, pa.int64()),
                        pa.array(starts[0], pa.int64()),
                        pa.array(starts[1], pa.int64()),
                        pa.array(ends, pa.int32()),
                        piece.column("value"),
                    ],
                    names=[f.split(" ")[0] for f in PARSED.split(", ")],
                )

    # A hash finds the places where the block may change; the names themselves then decide.
    return lines.withColumn("place", F.xxhash64(*BLOCK)).mapInArrow(run, PARSED)


def _bit(column: str, case: int) -> Column:
    return F.col(column).bitwiseAND(1 << case) != 0


@dataclass(frozen=True)
class Records:
    """Files whose blocks' cases are known."""

    lines: DataFrame
    blocks: DataFrame
    split_bytes: int

    @property
    def broken(self) -> bool:
        """Whether any record goes over several lines."""
        return not self.blocks.filter("opens").isEmpty()

    @property
    def unclosed(self) -> list[str]:
        """Files that end inside quotes, up to three."""
        last = self.blocks.groupBy("file").agg(F.max_by("ends_inside", "block").alias("inside"))
        return [r["file"] for r in last.filter("inside").select("file").limit(3).collect()]

    @property
    def headers(self) -> list[str]:
        """The different first lines, up to two."""
        first = self.blocks.filter("header is not null").select("header").distinct().limit(2)
        return [r["header"] for r in first.collect()]

    def read(self) -> DataFrame:
        """value, whole: the records without each file's first, and without empty lines; where files are not split as before, an error.

        ``whole`` is true in all rows. A check that may raise an error must ask for it first, as Spark may
        evaluate such a check before it has left the lines out that are no records.
        """
        moved = (F.col("block") % self.split_bytes != 0) | (F.col("length") > self.split_bytes)
        message = "the files' splits have changed since they were looked at; read the files again"
        steady = F.when(moved, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
        # Few blocks begin inside quotes: only these are joined, by a broadcast if Spark finds them small.
        inside = self.blocks.filter("begins_inside").select(*BLOCK, "from_block", "from_start")
        known = _parsed(self.lines).filter(steady).join(inside, BLOCK, "left")
        case = F.col("from_block").isNotNull()
        start = F.when(case, F.col("start1")).otherwise(F.col("start0"))
        known = known.select(
            "file",
            "block",
            "seq",
            "value",
            F.when(start >= 0, F.col("block")).otherwise(F.col("from_block")).alias("in_block"),
            F.when(start >= 0, start).otherwise(F.col("from_start")).alias("in_start"),
            F.when(case, _bit("ends", 1)).otherwise(_bit("ends", 0)).alias("open"),
        ).filter((F.col("in_block") > 0) | (F.col("in_start") > 0))
        alone = (F.col("block") == F.col("in_block")) & (F.col("seq") == F.col("in_start")) & ~F.col("open")
        parts = F.sort_array(F.collect_list(F.struct("block", "seq", "value")))
        joined = known.filter(~alone).groupBy("file", "in_block", "in_start").agg(parts.alias("parts"))
        stitched = joined.select(F.array_join("parts.value", "\n").alias("value"), F.lit(True).alias("whole"))
        value = F.col("value")
        ended = F.when(F.endswith(value, F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(value)
        records = known.filter(alone).select("value", alone.alias("whole")).unionByName(stitched)
        return records.select(ended.alias("value"), "whole").filter(F.trim("value") != "")


def records(spark: SparkSession, path: str | list[str], line_sep: str = "\n") -> Records:
    """Look at all lines once: a stored summary row for each block, and from their prefix each block's case."""
    lines = _lines(spark, path, line_sep)
    last = [F.max_by(c, "seq").alias(c) for c in ("start0", "start1", "ends")]
    first = F.min(F.when((F.col("block") == 0) & (F.col("seq") == 0), F.col("value"))).alias("header")
    # A record's first line that ends inside quotes, in either case.
    opens = [F.max((F.col(f"start{c}") == F.col("seq")) & _bit("ends", c)).alias(f"opens{c}") for c in (0, 1)]
    summary = _parsed(lines).groupBy(*BLOCK, "length").agg(*last, first, *opens)
    summary = materialise(summary, "csv-blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outside, inside = _bit("ends", 0).cast("int"), _bit("ends", 1).cast("int")
    # A block's function gives one case whatever it begins with, keeps the case, or swaps it: what counts
    # is the last one of the first sort, and the swaps since.
    swaps = F.coalesce(F.sum(((outside == 1) & (inside == 0)).cast("int")).over(before), F.lit(0))
    fixed = summary.withColumn("swaps", swaps)
    after = F.col("swaps") + ((outside == 1) & (inside == 0)).cast("int")
    given = F.last(F.when(outside == inside, F.struct(outside.alias("case"), after.alias("swaps"))), ignorenulls=True).over(before)
    cased = fixed.withColumn("given", given).withColumn(
        "begins_inside",
        (F.coalesce("given.case", F.lit(0)) + F.col("swaps") - F.coalesce("given.swaps", F.lit(0))) % 2 == 1,
    )

    def chosen(one: Column, other: Column) -> Column:
        return F.when(F.col("begins_inside"), other).otherwise(one)

    start = chosen(F.col("start0"), F.col("start1"))
    opened = F.when(start >= 0, F.struct(F.col("block"), start.alias("start")))
    cased = cased.withColumn("opened", opened).withColumn("carried", F.last("opened", ignorenulls=True).over(before))
    blocks = cased.select(
        *BLOCK,
        "length",
        "header",
        "begins_inside",
        chosen(F.col("opens0"), F.col("opens1")).alias("opens"),
        chosen(_bit("ends", 0), _bit("ends", 1)).alias("ends_inside"),
        F.when(F.col("begins_inside"), F.col("carried.block")).alias("from_block"),
        F.when(F.col("begins_inside"), F.col("carried.start")).alias("from_start"),
    )
    blocks = materialise(blocks, "csv-cases")
    return Records(lines, blocks, blocks.agg(F.max("length")).first()[0] or 1)
