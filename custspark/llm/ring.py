"""Shards on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of slices. A virtual node lies on a slice, and owns
the slices up to it: an arc. A row's key hashes to a slice; it belongs to that
arc's shard while the shard has room; what overflows goes on clockwise to the
next arc whose shard has room. Capacities differ by one at most, so the counts
of two shards do too.

Rows are never sorted or gathered by the driver: they are counted per slice and
lane (a fixed number of cells), the walk round the ring moves counts only, and a
row finds its place by its rank inside its cell.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custspark.llm.common import column
from custspark.session import materialise

#: The ring has 2 ** SLICE_BITS slices of LANES cells; this bounds all that reaches the driver.
SLICE_BITS, LANES = 12, 16
VIRTUAL_NODES = 64


def virtual_nodes(shards: int, each: int = VIRTUAL_NODES, slice_bits: int = SLICE_BITS) -> dict[int, int]:
    """Slice to shard, one entry for each virtual node; a node on a taken slice moves on clockwise."""
    if shards < 1 or shards * each > 1 << slice_bits:
        raise ValueError(f"{shards} shards with {each} virtual nodes do not fit {1 << slice_bits} slices")
    taken: dict[int, int] = {}
    for v in range(each):
        for s in range(shards):
            at = xxhash.xxh64_intdigest(f"{s}/{v}") >> (64 - slice_bits)
            while at in taken:
                at = (at + 1) % (1 << slice_bits)
            taken[at] = s
    return taken


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: np.ndarray, owners: list[int], rooms: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """Spread each arc's rows: (arc, from rank, to rank, shard, slot of the first).

    In round t an arc offers what it still has to the owner of the t-th arc
    clockwise; a shard takes offers in the order of the arcs until it is full.
    """
    n, left, placed = len(owners), counts.copy(), np.zeros(len(counts), np.int64)
    filled, room = [0] * len(rooms), list(rooms)
    for step in range(n):
        waiting = np.flatnonzero(left)
        if not len(waiting):
            return
        for arc in waiting.tolist():
            shard = owners[(arc + step) % n]
            if take := min(int(left[arc]), room[shard]):
                yield arc, int(placed[arc]), int(placed[arc]) + take, shard, filled[shard]
                left[arc] -= take
                placed[arc] += take
                room[shard] -= take
                filled[shard] += take
    if left.any():
        raise AssertionError("the shards have less room than there are rows")


def _pieces(
    counted: list[tuple[int, int]], shards: int, each: int, slice_bits: int, lanes: int
) -> dict[int, list[tuple[int, int, int]]]:
    """For each cell its pieces (first rank in the cell, shard, slot of that rank)."""
    nodes = virtual_nodes(shards, each, slice_bits)
    points = sorted(nodes)
    owners = [nodes[p] for p in points]
    # Cells in clockwise order; those beyond the last node belong to the first arc.
    arcs = [bisect_left(points, cell // lanes) % len(points) for cell, _ in counted]
    counts = np.zeros(len(points), np.int64)
    begins = []
    for arc, (_, n) in zip(arcs, counted):
        begins.append(int(counts[arc]))
        counts[arc] += n
    takes: list[list[tuple[int, int, int, int]]] = [[] for _ in points]
    for arc, low, high, shard_id, slot in walk(counts, owners, capacities(int(counts.sum()), shards)):
        takes[arc].append((low, high, shard_id, slot))
    return {
        cell: [
            (max(low - begin, 0), shard_id, slot + max(begin - low, 0))
            for low, high, shard_id, slot in takes[arc]
            if low < begin + n and begin < high
        ]
        for (cell, n), arc, begin in zip(counted, arcs, begins)
    }


def shard(
    docs: DataFrame,
    shards: int = 16,
    each: int = VIRTUAL_NODES,
    slice_bits: int = SLICE_BITS,
    lanes: int = LANES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus one. The slots of a shard are 0, 1, ...
    without gaps. A null text has size 1 and the checksum of an empty one; a null id
    has a place on the ring as any other. Repeated rows each get a slot: equal keys
    share a slice, and are dealt over its lanes. An empty table gives no rows.
    """
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    rows = docs.select(
        column(docs, id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # Written once: a lane depends on the row's place in the file, which must not move between the two jobs.
    rows = materialise(rows, "ring").withColumn("row", F.monotonically_increasing_id())
    at = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.col("text_crc32")), 64 - slice_bits)
    rows = rows.withColumn("cell", (at * lanes + F.pmod(F.xxhash64("row"), F.lit(lanes))).cast("int"))
    counted = sorted((r[0], r[1]) for r in rows.groupBy("cell").count().collect())
    pieces = _pieces(counted, shards, each, slice_bits, lanes)
    flat = [(cell, rank, shard_id, slot) for cell, parts in pieces.items() for rank, shard_id, slot in parts]
    columns = zip(*flat) if flat else ([], [], [], [])
    types = {"cell": pa.int32(), "from": pa.int64(), "shard": pa.int32(), "slot": pa.int64()}
    places = docs.sparkSession.createDataFrame(
        pa.table({n: pa.array(list(c), t) for (n, t), c in zip(types.items(), columns)})
    )
    places = places.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("from", "shard", "slot"))).alias("places"))
    rank = (F.row_number().over(Window.partitionBy("cell").orderBy("row")) - 1).cast("bigint")
    # Cells are bounded by the ring's constants, whatever the input: safe to broadcast.
    placed = rows.withColumn("rank", rank).join(F.broadcast(places), "cell")
    piece = F.element_at(F.filter("places", lambda p: p["from"] <= F.col("rank")), -1)
    return placed.withColumn("piece", piece).select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("piece.shard").alias("shard"),
        (F.col("piece.slot") + F.col("rank") - F.col("piece.from")).alias("slot"),
    )
