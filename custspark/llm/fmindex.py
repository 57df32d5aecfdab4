"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded run of a task's documents. Its index has the Burrows-Wheeler
transform as a wavelet tree over word ids, the suffixes' first-symbol counts, and
sampled suffix positions. Phrases are searched backward, all at once: each step
narrows their ranges by two ranks. Occurrences are located by walking back to a
sampled position; overlapping ones merge into removal spans.

Words that no phrase has can be part of no occurrence. They, and the ends of
documents, are folded into separators before the suffixes are sorted, and runs too
short for the shortest phrase are left out, which changes no occurrence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custspark.llm.common import ASCII_LOWER, column, prepare, raw_texts, released

#: Words of a phrase, words of text per index, distance of sampled positions, occurrences located at once.
WINDOW, SHARD_WORDS, SAMPLE, LOCATE = 10, 1_000_000, 16, 1_000_000
#: Bytes of benchmark text that one pass over the documents searches.
BLOCK_BYTES = 2 << 20

# Bytes that are no part of a word, after A-Z have become a-z.
DELIMITERS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_WORDS = bytes(0x20 if ASCII_LOWER[b] in DELIMITERS else ASCII_LOWER[b] for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TO_WORDS).split()


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletTree:
    """Rank and access of symbols, one bit vector for each bit of a symbol (levels in matrix order)."""

    def __init__(self, symbols: np.ndarray, symbol_count: int) -> None:
        self.depth = max(1, int(symbol_count - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        now = symbols
        for level in reversed(range(self.depth)):
            bit = ((now >> level) & 1).astype(bool)
            self.levels.append((Bits(bit), int(len(bit) - bit.sum())))
            now = np.concatenate([now[~bit], now[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros_like(at), at
        for level, (bits, zeros) in zip(reversed(range(self.depth)), self.levels):
            one = ((symbol >> level) & 1).astype(bool)
            low_ones, high_ones = bits.rank(low), bits.rank(high)
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before it."""
        symbol, low, here = np.zeros_like(at), np.zeros_like(at), at
        for bits, zeros in self.levels:
            one = bits.get(here).astype(bool)
            low_ones, here_ones = bits.rank(low), bits.rank(here)
            low = np.where(one, zeros + low_ones, low - low_ones)
            here = np.where(one, zeros + here_ones, here - here_ones)
            symbol = symbol * 2 + one
        return symbol, here - low


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions by their suffixes, by prefix doubling over those still tied.

    Symbol 0 separates; a separator is smaller than any word, and smaller than the
    separators after it, so no comparison goes on beyond it.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text + len(ends)
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    width = 1
    # rank: where the suffix's group of equals begins in the order
    in_order = rank[order]
    first = np.concatenate([[True], in_order[1:] != in_order[:-1]])
    begins = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = begins
    tied = np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))
    while len(tied):
        at = order[tied]
        # A suffix that reaches a separator is alone in its group, so at + width exists for every tied one.
        key = rank[at] * n + rank[at + width]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        first = np.concatenate([[True], key[1:] != key[:-1]])
        begins = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        rank[at] = begins
        tied = tied[~(first & np.concatenate([first[1:], [True]]))]
        width *= 2
    return order


class FMIndex:
    """Search in a text of symbols 1.. and separators 0, which it must end with."""

    def __init__(self, text: np.ndarray, symbol_count: int, sample: int = SAMPLE) -> None:
        n = len(text)
        order = suffix_order(text)
        self.size = n
        self.tree = WaveletTree(text[order - 1], symbol_count)  # order 0 wraps round to the last separator
        self.first = np.zeros(symbol_count + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=symbol_count), out=self.first[1:])
        # Sampled: every `sample`-th position, and those after a separator, which a walk back cannot cross.
        after = np.concatenate([[True], text[:-1] == 0])
        picked = (order % sample == 0) | after[order]
        self.sampled, self.places = Bits(picked), order[picked]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each phrase; a row of phrases is padded at its end."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                continue
            symbol = phrases[live, lengths[live] - back]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row's suffix."""
        out, left, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(left):
            done = self.sampled.get(at).astype(bool)
            out[left[done]] = self.places[self.sampled.rank(at[done])] + steps
            left, at = left[~done], at[~done]
            symbol, before = self.tree.access(at)
            at = self.first[symbol] + before
            steps += 1
        return out


@dataclass
class Phrases:
    """The distinct windows of a block of items, as rows of word ids, and the items of each."""

    ids: dict[bytes, int] = field(default_factory=dict)
    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, WINDOW), np.int64))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    items: list[tuple[str, ...]] = field(default_factory=list)

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int) -> Phrases:
        ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [ids.setdefault(w, len(ids) + 1) for w in words_of(text.encode())]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i : i + window]), set()).add(item)
        rows = np.zeros((len(found), window), np.int64)
        for i, phrase in enumerate(found):
            rows[i, : len(phrase)] = phrase
        lengths = np.array([len(p) for p in found], np.int64)
        return cls(ids, rows, lengths, [tuple(sorted(v)) for v in found.values()])


def search(docs: list[list[bytes]], phrases: Phrases) -> tuple[list[np.ndarray], list[list[str]]]:
    """For each document which of its words are hit, and the items whose windows occur."""
    hits = [np.zeros(len(w), bool) for w in docs]
    items: list[set[str]] = [set() for _ in docs]
    if not len(phrases.lengths):
        return hits, [[] for _ in docs]
    shortest, get = int(phrases.lengths.min()), phrases.ids.get
    parts, starts = [], []  # runs of known words: their ids and a separator, and where they start over all words
    offset = 0
    for words in docs:
        known = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        edge = np.diff(np.concatenate([[0], (known > 0).astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if b - a >= shortest:
                parts += [known[a:b], np.zeros(1, np.int64)]
                starts.append((offset + a, b - a + 1))
        offset += len(words)
    if not parts:
        return hits, [[] for _ in docs]
    text = np.concatenate(parts)
    begin, length = np.array(starts, np.int64).T
    place = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(len(text))
    index = FMIndex(text, len(phrases.ids) + 1)
    low, high = index.ranges(phrases.rows, phrases.lengths)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in docs])])
    edges = np.zeros(offset + 1, np.int64)
    counts = np.maximum(high - low, 0)
    total = np.concatenate([[0], np.cumsum(counts)])
    for begin_at in range(0, int(total[-1]), LOCATE):
        rows = np.arange(begin_at, min(begin_at + LOCATE, int(total[-1])))
        which = np.searchsorted(total, rows, "right") - 1
        at = place[index.locate(low[which] + rows - total[which])]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + phrases.lengths[which], -1)
        doc = np.searchsorted(bounds, at, "right") - 1
        for d, p in np.unique(np.stack([doc, which], 1), axis=0).tolist():
            items[d].update(phrases.items[p])
    hit = np.cumsum(edges[:-1]) > 0
    return [hit[a:b] for a, b in zip(bounds[:-1], bounds[1:])], [sorted(i) for i in items]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size; those without words are left out, a longer item is a block."""
    rows = benchmark.select(
        column(benchmark, id_col).cast("string").alias("item"), column(benchmark, text_col).cast("string").alias("text")
    ).dropDuplicates()
    block: list[tuple[str, str]] = []
    size = 0
    for item, text in rows.filter("item is not null and text is not null").toLocalIterator():
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    if block:
        yield block


def spans(hit: np.ndarray) -> list[int]:
    """Starts and ends of the runs of hit words, alternating."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()


def _pass(packed: DataFrame, phrases: Phrases, last: bool, clean: bool = False) -> DataFrame:
    """Search one block, and add to what the blocks before it have found; the last gives cleaned texts or none."""
    shared = packed.sparkSession.sparkContext.broadcast(phrases)
    schema = packed.schema
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        for batch in batches:
            words = [words_of(raw) for raw in raw_texts(batch.column("text"))]
            old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            out_spans: list[list[int]] = []
            out_items: list[list[str]] = []
            low = 0
            while low < len(words):
                high, size = low, 0
                while high < len(words) and (high == low or size + len(words[high]) <= SHARD_WORDS):
                    size += len(words[high])
                    high += 1
                hits, items = search(words[low:high], mine)
                for hit, found, spans_before, items_before in zip(
                    hits, items, old_spans[low:high], old_items[low:high]
                ):
                    for a, b in zip((spans_before or [])[::2], (spans_before or [])[1::2]):
                        hit[a:b] = True
                    out_spans.append(spans(hit))
                    out_items.append(sorted({*found, *(items_before or [])}))
                low = high
            texts = batch.column("text")
            if last and clean:
                raw = texts.cast(pa.binary()).to_pylist()
                texts = pa.array([None if t is None else without(t, s).decode() for t, s in zip(raw, out_spans)], pa.string())
            elif last:
                texts = pa.nulls(batch.num_rows, pa.string())
            arrays = [
                batch.column("row"),
                texts,
                pa.array([len(w) for w in words], pa.int64()),
                pa.array(out_spans, pa.list_(pa.int64())),
                pa.array(out_items, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return packed.mapInArrow(released(run), schema)


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    clean: bool = False,
) -> DataFrame:
    """Struct ``row`` of the columns kept, n_words, spans, items of each document; with ``clean`` its cleaned text.

    spans holds the starts and ends (exclusive) of the runs of hit words, alternating;
    items the sorted ids of items with a window in the text. A null or empty text has
    no words; an item without words or without an id finds nothing; repeated items count
    once, and repeated documents each get their row. An empty benchmark hits nothing.
    """
    prepare(docs.sparkSession)
    packed = docs.select(
        F.struct(*[column(docs, c) for c in keep]).alias("row"),
        column(docs, text_col).cast("string").alias("text"),
        F.lit(None).cast("bigint").alias("n_words"),
        F.lit(None).cast("array<bigint>").alias("spans"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    pending = Phrases()
    for block in blocks(benchmark, item_col, item_text_col, block_bytes):
        if len(pending.lengths):
            packed = _pass(packed, pending, last=False)
        pending = Phrases.of(block, window)
    found = _pass(packed, pending, last=True, clean=clean)
    return found if clean else found.drop("text")


def digests(found: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated beside ``row``."""
    positions = F.sequence(F.lit(0), F.size("spans") - 1)
    signed = F.transform(positions, lambda i: F.when(i % 2 == 1, F.get("spans", i)).otherwise(-F.get("spans", i)))
    n_hit = F.when(F.size("spans") > 0, F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(
        F.lit(0).cast("bigint")
    )
    return found.select(
        "row",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def cleaned(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options: object) -> DataFrame:
    """The documents without the bytes of their hit words, with their own columns; a text that is all hit becomes empty.

    A removal span runs from its first hit word to its last; what stood around it is
    joined by one space. Texts without hits are unchanged, nulls included.
    """
    others = [c for c in docs.columns if c != text_col]  # the text goes to the tasks once
    found = find(docs, benchmark, others or [text_col], text_col=text_col, clean=True, **options)
    return found.select(*[F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns])


def without(raw: bytes, spans: list[int]) -> bytes:
    """The text without the words of the spans."""
    if not spans:
        return raw
    places = [m.span() for m in re.finditer(rb"[^\x20]+", raw.translate(_TO_WORDS))]
    parts, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        parts.append(raw[at : places[a][0]].rstrip(b" "))
        at = places[b - 1][1]
    parts.append(raw[at:].lstrip(b" "))
    return b" ".join(p for p in parts if p)
