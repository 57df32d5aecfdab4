"""Byte-pair encoding with content-defined chunk reuse, and decoding.

A rolling hash over the text's bytes cuts it into chunks: where the text is the
same, so are the cuts. A chunk met again in a task, in the same or another
document, is not encoded again. A cut may fall inside a word, so the tokens next
to it can be wrong; every join is repaired by encoding the text around it anew,
from a place left of the cut to one right of it at which the chunks' tokens agree
with the text encoded in one piece.

Such a place is the start of white space after a printable ASCII character: the
vocabulary's pattern never lets a piece of text go on across it, whatever stands
before or after, so it starts a token in the chunk, in the repaired span, and in the
whole text. If a chunk has none, the span grows into the next chunk, at last to the
whole text. The result is therefore that of encoding the text in one piece.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from custspark.llm.common import Measure, extend, raw_texts

#: A cut every 2 ** CUT_BITS bytes on average, after WINDOW bytes that decide it.
CUT_BITS, WINDOW = 11, 32
#: A chunk without a cut ends here, so that one very long text is not one chunk.
MOST_CHUNK = 1 << 16
#: Bytes of chunks and their tokens that a task keeps.
CACHE_BYTES = 48 << 20

# The pattern of the byte-level vocabulary, and the printable bytes that its file writes as themselves.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

SAFE = re.compile(rb"[!-~](?=[ \n])")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """A byte-level vocabulary file: its encoder, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        others = [b for b in range(256) if b not in set(PRINTABLE)]
        byte_of = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.special = [s.encode() for s in special]
        self.encoder = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.pieces: list[bytes] = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for piece, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.pieces[i] = piece
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)

    def encode(self, raw: bytes) -> np.ndarray:
        return np.array(self.encoder.encode(raw.decode(), allowed_special="all"), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_TABLE = np.random.default_rng(6).integers(0, 1 << 32, 256, dtype=np.uint32)
_BASE = 0x9E3779B1


def cuts(raw: bytes, bits: int = CUT_BITS, most: int = MOST_CHUNK) -> list[int]:
    """Where chunks end, without the text's ends; never inside a character."""
    n = len(raw)
    if n <= WINDOW:
        return []
    data = np.frombuffer(raw, np.uint8)
    rolled, width, power = _TABLE[data], 1, np.uint32(_BASE)
    while width < WINDOW:  # the hash of twice as many bytes is that of two neighbours
        wider = rolled.copy()
        wider[width:] += rolled[:-width] * power
        rolled, width, power = wider, 2 * width, np.uint32(int(power) ** 2 & 0xFFFFFFFF)
    at = np.flatnonzero((rolled[WINDOW - 1 : -1] >> np.uint32(32 - bits)) == 0) + WINDOW
    found = at[(data[at] & 0xC0) != 0x80].tolist()
    if n <= most:
        return found
    out, last = [], 0
    for end in [*found, n]:
        while end - last > most:
            last += most
            while last > 0 and data[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if end < n and end > last:
            out.append(end)
            last = end
    return out


class ChunkEncoder:
    """Encodes texts by way of chunks; what it keeps is bounded."""

    def __init__(self, words: Vocabulary, bits: int = CUT_BITS, most: int = MOST_CHUNK, cache: int = CACHE_BYTES) -> None:
        self.vocabulary, self.bits, self.most, self.room = words, bits, most, cache
        self.kept: dict[bytes, np.ndarray] = {}
        self.left = cache
        self.encoded_bytes = 0

    def chunk(self, raw: bytes) -> np.ndarray:
        ids = self.kept.get(raw)
        if ids is None:
            ids = self.vocabulary.encode(raw)
            self.encoded_bytes += len(raw)
            size = len(raw) + ids.nbytes + 200
            if size > self.left:
                self.kept, self.left = {}, self.room
            if size <= self.left:
                self.kept[raw] = ids
                self.left -= size
        return ids

    def repairs(self, raw: bytes, at: list[int]) -> list[tuple[int, int]]:
        """The spans around cuts that are encoded anew, in order and apart."""
        out: list[tuple[int, int]] = []
        for cut in at:
            if out and cut <= out[-1][1]:
                continue
            low = out[-1][1] if out else 0
            back, start = 64, -1
            while start < 0:
                begin = max(low, cut - back)
                ends = [m.end() for m in SAFE.finditer(raw, begin, cut + 1)]
                if ends and ends[-1] <= cut:
                    start = ends[-1]
                elif begin == low:
                    start = low
                back *= 4
            if start == cut:
                continue  # the cut itself is such a place
            right = SAFE.search(raw, cut)
            stop = right.end() if right else len(raw)
            if out and start == out[-1][1] and not SAFE.match(raw, start - 1):
                start = out.pop()[0]
            out.append((start, stop))
        return out

    def encode(self, raw: bytes) -> np.ndarray:
        at = cuts(raw, self.bits, self.most)
        if not at:
            return self.chunk(raw)
        spans = self.repairs(raw, at)
        parts: list[np.ndarray] = []
        span = 0
        for start, stop in zip([0, *at], [*at, len(raw)]):
            # What of this chunk lies between the repaired spans, and the spans that start in it.
            while span < len(spans) and spans[span][1] <= start:
                span += 1
            ids, ends, here, k = None, None, start, span
            while here < stop:
                if k < len(spans) and spans[k][0] <= here:
                    if spans[k][0] >= start:
                        parts.append(self.chunk(raw[spans[k][0] : spans[k][1]]))
                    here, k = max(here, spans[k][1]), k + 1
                    continue
                until = min(stop, spans[k][0]) if k < len(spans) else stop
                if ids is None:
                    ids = self.chunk(raw[start:stop])
                    ends = np.cumsum(self.vocabulary.lengths[ids])
                i, j = np.searchsorted(ends, (here - start, until - start), "left")
                i, j = (i + 1 if here > start else 0), j + 1
                if (i and ends[i - 1] != here - start) or ends[j - 1] != until - start:
                    return self.chunk(raw)  # no agreement: the whole text in one piece
                parts.append(ids[i:j])
                here = until
        return np.concatenate(parts)


def encode(
    docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Struct ``row`` of the columns kept, and ids (array<int>): the whole text's tokens.

    A null or empty text has none. Special tokens' strings in a text are those tokens.
    """
    where = path or default_vocabulary()

    def start() -> Measure:
        chunks = ChunkEncoder(vocabulary(where))
        return lambda _, texts: [pa.array([chunks.encode(t).astype(np.int32) for t in raw_texts(texts)], pa.list_(pa.int32()))]

    return extend(docs, start, "ids array<int>", keep, id_col, text_col)


def digests(
    docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Struct ``row`` of the columns kept, and n_tokens, ids_sha256, decoded_sha256.

    The digests of the ids as little-endian unsigned 32-bit integers, and of the
    text decoded from them, so that neither leaves the task.
    """
    where = path or default_vocabulary()

    def start() -> Measure:
        words = vocabulary(where)
        chunks = ChunkEncoder(words)

        def measure(_: pa.Array, texts: pa.Array) -> list[pa.Array]:
            all_ids = [chunks.encode(t) for t in raw_texts(texts)]
            return [
                pa.array([len(i) for i in all_ids], pa.int64()),
                pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in all_ids], pa.string()),
                pa.array([hashlib.sha256(words.decode(i).encode()).hexdigest() for i in all_ids], pa.string()),
            ]

        return measure

    return extend(docs, start, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", keep, id_col, text_col)
