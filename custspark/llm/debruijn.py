"""Removal of long repeated passages by a De Bruijn graph of word k-mers.

A window of 50 words is an edge of the graph. Windows that share their minimizer (of
the short k-mers inside, the one with the smallest hash) and follow each other in a
document are one path, kept as one row: its anchor k-mer and a hash of all its words.
Equal windows have equal anchors, wherever they are, so:

* anchors that only one document has are dropped: their paths are not repeated,
* a path whose words are those of an earlier document's is repeated as a whole; it does
  not branch, and stays one row through the joins,
* only anchors at which paths differ are forks; their paths alone are spread into single
  edges, wherever the first document that has them has them, and a join compares these.

Each repeated path or edge carries the coordinates of the occurrence it repeats. Paths
that go on together in both documents are compacted into one span, and every span's
words are verified against the hash at its coordinates before they are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custspark.llm.common import Windows, column, emit, mixed, prepare, raw_texts, released, signed, word_hashes
from custspark.session import materialise

#: Words of a window, words of an anchor.
WINDOW, ANCHOR = 50, 12
_PLACE_BITS = 28


def paths(hashes: np.ndarray, windows: Windows, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """anchor, content, start, n of the paths of a text: runs of n windows from start that share a minimizer."""
    n = len(hashes) - window + 1
    if n < 1:
        empty = np.empty(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty
    kmers = windows.of(hashes, anchor)
    place = np.arange(len(kmers), dtype=np.uint64)
    low_bits = np.uint64((1 << _PLACE_BITS) - 1)
    # Smallest hash, then leftmost: equal windows choose alike, as the order of places is the same in them.
    least, width, want = (mixed(kmers, 3) & ~low_bits) | place, 1, window - anchor + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = (least & low_bits).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, n))
    content = windows.spans(hashes, first, first + count + window - 1)
    return kmers[at[first]], content, first, count


def chunks(docs: DataFrame, window: int, anchor: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, anchor, content, start, n: the paths of each document that has an id."""

    def start():
        windows = Windows()

        def each(ids: pa.Array, texts: pa.Array) -> Iterator[dict[str, pa.Array]]:
            found = [paths(word_hashes(raw.split()), windows, window, anchor) for raw in raw_texts(texts)]
            owner = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            anchors, contents, starts, counts = (np.concatenate(c) for c in zip(*found))
            yield {
                "doc_id": ids.take(pa.array(owner)),
                "anchor": pa.array(signed(anchors)),
                "content": pa.array(signed(contents)),
                "start": pa.array(starts.astype(np.int32)),
                "n": pa.array(counts.astype(np.int32)),
            }

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, anchor bigint, content bigint, start int, n int"
    return emit(docs.filter(column(docs, id_col).isNotNull()), start, schema, id_col, text_col)


def _edges(docs: DataFrame, forks: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, edge, start: single windows of the paths at forks, found in their source texts."""
    wanted = forks.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n", "content")).alias("spans"))
    wanted = materialise(wanted, "repeats-forks")
    named = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows()
        for batch in batches:
            owner, edges, starts = [], [], []
            spans = batch.column("spans").to_pylist()
            for i, raw in enumerate(raw_texts(batch.column("text"))):
                hashes = word_hashes(raw.split())
                for a, n in verified(hashes, spans[i], windows, window):
                    own = np.arange(a, a + n)
                    owner.append(np.full(n, i))
                    starts.append(own)
                    # From these words alone, so that a long text is not summed for each of its paths.
                    edges.append(windows.of(hashes[a : a + n + window - 1], window))
            if owner:
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").take(pa.array(np.concatenate(owner))),
                        "edge": pa.array(signed(np.concatenate(edges))),
                        "start": pa.array(np.concatenate(starts).astype(np.int32)),
                    }
                )

    return named.join(wanted, "doc_id").mapInArrow(released(run), f"doc_id {kind}, edge bigint, start int")


def verified(hashes: np.ndarray, spans: list[dict], windows: Windows, window: int) -> list[tuple[int, int]]:
    """start, n of the spans whose words have the stated hash: several texts may have one id."""
    spans = [s for s in spans if s["start"] + s["n"] + window - 1 <= len(hashes)]
    if not spans:
        return []
    starts, counts = np.array([s["start"] for s in spans]), np.array([s["n"] for s in spans])
    right = signed(windows.spans(hashes, starts, starts + counts + window - 1)) == np.array([s["content"] for s in spans])
    return [(int(a), int(n)) for a, n in zip(starts[right], counts[right])]


def repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, start, n, content, source_id, source_start: n windows from a word on that an earlier document has.

    source_id is the smallest id with these words, content their hash. Documents without
    an id neither repeat nor are repeated. Window occurrences inside one document, or in
    rows of one id, are no repeats.
    """
    all_paths = materialise(chunks(docs, window, anchor, id_col, text_col), "repeats-paths")
    shared = (
        all_paths.groupBy("anchor")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .filter("low < high")
        .select("anchor")
    )
    near = materialise(all_paths.join(materialise(shared, "repeats-anchors"), "anchor", "left_semi"), "repeats-near")
    contents = materialise(
        near.groupBy("anchor", "content").agg(
            F.min(F.struct("doc_id", "start")).alias("source"), F.max("doc_id").alias("last"), F.first("n").alias("n")
        ),
        "repeats-contents",
    )
    copied = materialise(
        contents.filter("source.doc_id < last").select("anchor", "content", "source"), "repeats-copied"
    )
    whole = near.join(copied, ["anchor", "content"]).filter("doc_id > source.doc_id")
    branching = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1")
    forks = contents.join(materialise(branching.select("anchor"), "repeats-branching"), "anchor", "left_semi")
    # Every place of such a path in the document that has it first: the later documents' are repeated as a whole.
    forks = forks.select("anchor", "content", F.col("source.doc_id").alias("doc_id"))
    forks = near.join(materialise(forks, "repeats-fork-paths"), ["anchor", "content", "doc_id"], "left_semi")
    edges = materialise(_edges(docs, forks, window, id_col, text_col), "repeats-edges")
    earliest = (
        edges.groupBy("edge")
        .agg(F.min(F.struct("doc_id", "start")).alias("source"), F.max("doc_id").alias("last"))
        .filter("source.doc_id < last")
        .select("edge", "source")
    )
    single = edges.join(materialise(earliest, "repeats-earliest"), "edge").filter("doc_id > source.doc_id")
    found = [
        whole.select("doc_id", "start", "n", "content", "source"),
        single.select("doc_id", "start", F.lit(1).alias("n"), F.col("edge").alias("content"), "source"),
    ]
    return found[0].union(found[1]).select(
        "doc_id",
        "start",
        "n",
        "content",
        F.col("source.doc_id").alias("source_id"),
        F.col("source.start").alias("source_start"),
    )


def covered(hashes: np.ndarray, spans: list[dict] | None, windows: Windows, window: int) -> np.ndarray:
    """Which words verified windows cover."""
    edges = np.zeros(len(hashes) + 1, np.int64)
    for a, n in verified(hashes, spans or [], windows, window):
        edges[a] += 1
        edges[a + n + window - 1] -= 1
    return np.cumsum(edges[:-1]) > 0


def compacted(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start, end, source_id, source_start: spans of words that go on together in a document and its source.

    Paths of one document, at one distance from one source, that overlap or meet are one
    span: the unbranched path through the graph that both documents follow.
    """
    order = Window.partitionBy("doc_id", "source_id", "shift").orderBy("start", "end")
    spans = found.select(
        "doc_id",
        "start",
        (F.col("start") + F.col("n") + window - 1).alias("end"),
        "source_id",
        (F.col("source_start") - F.col("start")).alias("shift"),
    )
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("begins", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int"))
    numbered = begun.withColumn("span", F.sum("begins").over(order))
    return (
        numbered.groupBy("doc_id", "source_id", "shift", "span")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .select("doc_id", "start", "end", "source_id", (F.col("start") + F.col("shift")).alias("source_start"))
    )


FIELDS = "n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"


def remove(
    docs: DataFrame,
    keep: list[str],
    window: int = WINDOW,
    anchor: int = ANCHOR,
    texts: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Struct ``row`` of the columns kept; n_words, n_removed, kept_sha256; kept_text (if ``texts``).

    Words of windows that also start in a document with a smaller id are removed; what
    is kept is joined by one space. A null or empty text has no words, a null id removes
    nothing; rows of one id are each compared with smaller ids, and texts of fewer words
    than a window have no repeats. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    found = repeats(docs, window, anchor, id_col, text_col)
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "content")).alias("spans"))
    spans = materialise(spans, "repeats-spans")
    packed = docs.select(
        F.struct(*[column(docs, c) for c in keep]).alias("row"),
        column(docs, id_col).alias("doc_id"),
        column(docs, text_col).cast("string").alias("text"),
    )
    schema = T.StructType([packed.schema["row"], *T._parse_datatype_string(FIELDS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows()
        for batch in batches:
            rows = []
            for raw, mine in zip(raw_texts(batch.column("text")), batch.column("spans").to_pylist()):
                words = raw.split()
                gone = covered(word_hashes(words), mine, windows, window) if mine else np.zeros(len(words), bool)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if mine else b" ".join(words)
                digest = hashlib.sha256(kept).hexdigest()
                rows.append((len(words), int(gone.sum()), digest, kept.decode() if texts else None))
            columns = list(zip(*rows)) if rows else [()] * 4
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], names=schema.names)

    with_id = packed.filter("doc_id is not null").join(spans, "doc_id", "left").select("row", "text", "spans")
    without = packed.filter("doc_id is null").select("row", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return with_id.mapInArrow(released(run), schema).unionByName(without.mapInArrow(released(run), schema))
