"""Language-model scores of whole documents, and an add-one unigram score beside them.

1. Every training document's words are counted; the counts are a table.
2. The recurrent model is trained by all tasks at once, each over all training documents of
   its partition, and the tasks' parameters are averaged by their tokens. A first round
   over a share of the documents gives all tasks the same start for the second, over all.
3. Every document is scored in full by the averaged model. Frequent words' counts are
   broadcast (a fixed number of bounded length); the others meet their counts in a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custspark.llm.common import ASCII_LOWER, column, prepare, released
from custspark.llm.gru import Model, Shape, Trainer, log10_likelihood
from custspark.session import materialise

#: Frequent words known to every task, the bytes such a word may have, and tokens a task counts before it passes them on.
FREQUENT, FREQUENT_BYTES, COUNTED_AT_ONCE = 1 << 17, 64, 3_000_000
#: Tokens that are dealt to the model's lanes at once, and the share of documents of the first round.
TOKENS_AT_ONCE, FIRST_ROUND = 1_500_000, 16
#: Tokens that are scored at once: the longest text's steps serve more of the others, and nothing is learned between them.
SCORED_AT_ONCE = 4_000_000
#: Parameters per row on their way to the average, and partial averages of each such block.
BLOCK, PARTIAL = 8192, 32

END = b""


#: For each byte, whether it belongs to a word.
_IN_WORD = bytes(b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256))


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of the texts in lower-case ASCII, each text's end after them; and the number of tokens of each text.

    A null text has an end only. All texts are cut at once, by their bytes.
    """
    raw = pc.fill_null(texts.cast(pa.large_string()).cast(pa.large_binary()), b"")
    edges = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = (raw.buffers()[2] or pa.py_buffer(b""))[edges[0] : edges[-1]].to_pybytes()
    edges = edges - edges[0]
    inside = np.frombuffer(data.translate(_IN_WORD), np.bool_)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = edges[:-1][edges[:-1] < len(data)]
    begins[heads] = inside[heads]
    packed = np.frombuffer(data.translate(ASCII_LOWER), np.uint8)[inside]
    at = np.append(np.flatnonzero(begins[inside]), len(packed))
    words = np.searchsorted(np.flatnonzero(begins), edges[1:])
    # The end is an empty word where the text's last word has ended.
    offsets = np.insert(at, words, at[words])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(packed)]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers), np.diff(words, prepend=0) + 1


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, by 7, leaves 2; a null id is as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


@dataclass
class Lexicon:
    """What a task knows about words: frequent ones by number, with their counts; others by class."""

    words: pa.Array
    counts: np.ndarray
    model_words: int
    other_tokens: np.ndarray
    other_words: np.ndarray
    shape: Shape = field(default_factory=Shape)

    def other_class(self, word: bytes) -> int:
        return zlib.crc32(word[-2:]) % self.shape.other_classes

    def __post_init__(self) -> None:
        # The class of each word's end: of two bytes, of one and of none.
        pairs = [bytes([a, b]) for a in range(256) for b in range(256)]
        ends = [*pairs, *(bytes([a]) for a in range(256)), b""]
        self.end_classes = np.array([self.other_class(e) for e in ends], np.int32) + np.int32(self.model_words)
        outside = [self.model_words + self.other_class(w) for w in self.words[self.model_words :].to_pylist()]
        self.model_id = np.array([*range(self.model_words), *outside, 0], np.int32)

    def ids(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The model's input ids, and each token's number among frequent words or -1."""
        number = pc.fill_null(pc.index_in(tokens, value_set=self.words), -1).to_numpy()
        model = self.model_id[number]
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            _, offsets, raw = tokens.buffers()
            offsets = np.frombuffer(offsets, np.int64)[tokens.offset :]
            raw = np.frombuffer(raw if raw is not None and raw.size else b"\0", np.uint8)
            high = offsets[unknown + 1]
            size = high - offsets[unknown]
            last, second = raw[np.maximum(high - 1, 0)].astype(np.int64), raw[np.maximum(high - 2, 0)]
            end = np.where(size > 1, second * np.int64(256) + last, np.where(size == 1, 65536 + last, 65792))
            model[unknown] = self.end_classes[end]
        return model, number

    @property
    def end(self) -> int:
        return int(self.ids(pa.array([END], pa.large_binary()))[0][0])


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word, n of the training documents: counted per task, then summed. The end is the empty word."""

    def batch_of(tokens: list[pa.Array]) -> pa.RecordBatch:
        counts = pa.chunked_array(tokens).value_counts()
        words = counts.field(0).cast(pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, counts.field(1)], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Array] = []
        size = 0
        for batch in batches:
            kept.append(tokens_of(batch.column(0))[0])
            size += len(kept[-1])
            if size >= COUNTED_AT_ONCE:
                yield batch_of(kept)
                kept, size = [], 0
        if size:
            yield batch_of(kept)

    learned = docs.filter(~held_out(column(docs, id_col))).select(column(docs, text_col).cast("string").alias("text"))
    return learned.mapInArrow(released(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_of(counts: DataFrame, shape: Shape, frequent: int = FREQUENT) -> tuple[Lexicon, int, int]:
    """What tasks are to know, the training tokens and the distinct ones among them."""
    n_tokens, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # At most `frequent` words of bounded length reach the driver, whatever the corpus.
    short = counts.filter(F.octet_length("word") <= FREQUENT_BYTES)
    top = short.orderBy(F.col("n").desc(), "word").limit(frequent).toArrow()
    words = top.column("word").cast(pa.binary()).to_pylist()
    numbers = top.column("n").to_numpy().astype(np.int64)
    model_words = min(shape.words, len(words))
    last = F.expr("crc32(substring(cast(word as binary), -2, 2))") % shape.other_classes
    classes = counts.groupBy(last.alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("w")).collect()
    tokens, distinct = np.zeros(shape.other_classes), np.zeros(shape.other_classes)
    for r in classes:
        tokens[r["c"]], distinct[r["c"]] = r["n"], r["w"]
    lexicon = Lexicon(pa.array(words, pa.large_binary()), numbers, model_words, tokens, distinct, shape)
    for word, n in zip(words[:model_words], numbers[:model_words].tolist()):
        tokens[lexicon.other_class(word)] -= n
        distinct[lexicon.other_class(word)] -= 1
    return lexicon, int(n_tokens), int(n_words)


def _super_batches(
    batches: Iterator[pa.RecordBatch], lexicon: Lexicon, columns: int, most: int = TOKENS_AT_ONCE
) -> Iterator[tuple]:
    """Rows of several batches up to a number of tokens: their model ids and numbers, the texts' tokens, unknown words."""
    rows: list[pa.RecordBatch] = []
    tokens: list[pa.Array] = []
    sizes: list[np.ndarray] = []
    size = 0

    def known() -> tuple:
        every = pa.concat_arrays(tokens)
        model, number = lexicon.ids(every)
        return rows, model, number, np.concatenate(sizes), every.filter(pa.array(number < 0))

    for batch in batches:
        rows.append(batch.select(range(columns)))
        found, lengths = tokens_of(batch.column(columns))
        tokens.append(found)
        sizes.append(lengths)
        size += len(found)
        if size >= most:
            yield known()
            rows, tokens, sizes, size = [], [], [], 0
    if size:
        yield known()


def _texts(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The ids of each text."""
    return np.split(ids, np.cumsum(sizes)[:-1])


def _round(docs: DataFrame, lexicon: object, begin: np.ndarray | None, text_col: str) -> np.ndarray | None:
    """Parameters after one pass of all tasks over these documents: the mean, weighted by tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(begin)
    known = lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: Lexicon = known.value
        model = _model(mine, sent.value)
        trainer = Trainer(model)
        for _, ids, _, sizes, _ in _super_batches(batches, mine, 0):
            trainer.train(_texts(ids, sizes), mine.end)
        if trainer.tokens:
            n = trainer.tokens
            for block, low in enumerate(range(0, len(model.vector), BLOCK)):
                part = (model.vector[low : low + BLOCK].astype(np.float64) * n).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int32()),
                        pa.array([n % PARTIAL], pa.int32()),
                        pa.array([n], pa.int64()),
                        pa.array([part], pa.binary()),
                    ],
                    names=["block", "salt", "tokens", "sums"],
                )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table.column("sums")[0].as_py()) // 8)
        for part in table.column("sums"):
            total += np.frombuffer(part.as_py())
        first = table.slice(0, 1)
        n = int(np.sum(table.column("tokens").to_numpy()))
        return pa.table(
            {
                "block": first.column("block"),
                "salt": first.column("salt"),
                "tokens": pa.array([n], pa.int64()),
                "sums": pa.array([total.tobytes()], pa.binary()),
            }
        )

    schema = "block int, salt int, tokens bigint, sums binary"
    parts = docs.select(column(docs, text_col).cast("string").alias("text")).mapInArrow(released(run), schema)
    some = parts.groupBy("block", "salt").applyInArrow(add, schema)
    blocks = some.groupBy("block").applyInArrow(add, schema).orderBy("block").collect()  # the model's own, fixed size
    if not blocks:
        return begin
    return np.concatenate([np.frombuffer(b["sums"]) / b["tokens"] for b in blocks]).astype(np.float32)


def _model(lexicon: Lexicon, vector: np.ndarray | None) -> Model:
    if vector is None:
        return Model.fresh(lexicon.shape, lexicon.counts[: lexicon.model_words], np.maximum(lexicon.other_tokens, 0))
    return Model(lexicon.shape, lexicon.model_words, vector)


FIELDS = (
    "n_tokens bigint, n_known bigint, logs double, model double, others array<bigint>"
)


def score(
    docs: DataFrame,
    shape: Shape = Shape(),
    frequent: int = FREQUENT,
    first_round: int = FIRST_ROUND,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document.

    base_score is the add-one unigram log10 probability of the text, score the model's.
    Texts whose crc32(id) leaves 2 by 7 are held out of counting and training. A null
    text is empty: one end token. Repeated rows are learned and scored as often as they
    are there; a null id is learned from. Without training documents every base
    probability is one, and the model is uniform over its classes.
    """
    spark = docs.sparkSession
    prepare(spark)
    counts = materialise(word_counts(docs, id_col, text_col), "lm-counts")
    lexicon, n_tokens, n_words = lexicon_of(counts, shape, frequent)
    known = spark.sparkContext.broadcast(lexicon)
    learned = docs.filter(~held_out(column(docs, id_col)))
    mark = F.xxhash64(column(docs, id_col).cast("string"), F.octet_length(column(docs, text_col).cast("string")))
    share = learned.filter(F.pmod(mark, F.lit(first_round)) == 0)
    vector = _round(share, known, None, text_col)
    vector = _round(learned, known, vector, text_col)
    sent = spark.sparkContext.broadcast(vector)
    other = np.log10(np.maximum(lexicon.other_tokens, 0) + np.maximum(lexicon.other_words, 0) + 1)

    packed = docs.select(
        column(docs, id_col).alias("doc_id"),
        held_out(column(docs, id_col)).alias("held_out"),
        column(docs, text_col).cast("string").alias("text"),
    )
    schema = T.StructType([*packed.schema.fields[:2], *T._parse_datatype_string(FIELDS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: Lexicon = known.value
        model = _model(mine, sent.value)
        logs_of = np.log10(mine.counts + 1)
        for rows, ids, numbers, sizes, unknown in _super_batches(batches, mine, 2, SCORED_AT_ONCE):
            scores = log10_likelihood(model, _texts(ids, sizes), mine.end)
            # Every text has an end at least, so no text's slice is empty.
            firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            seen = numbers >= 0
            n_known = np.add.reduceat(seen, firsts, dtype=np.int64)
            counted = np.where(seen, logs_of[numbers], 0)
            # Words outside the model's: their share of their class; the counts of those not frequent join later.
            outside = np.maximum(ids - mine.model_words, 0)
            inside = np.where(ids >= mine.model_words, counted - other[outside], 0)
            hashes = [xxhash.xxh64_intdigest(w, seed=42) for w in unknown.to_pylist()]
            ends = np.concatenate([[0], np.cumsum(sizes - n_known)]).astype(np.int32)
            arrays = [
                pa.array(sizes, pa.int64()),
                pa.array(n_known),
                pa.array(np.add.reduceat(counted, firsts)),
                pa.array(scores + np.add.reduceat(inside, firsts)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(hashes, np.uint64).view(np.int64))),
            ]
            table = pa.Table.from_batches(rows).combine_chunks()
            made = pa.table([*table.columns, *arrays], names=schema.names)
            yield from made.to_batches(max_chunksize=2000)

    # Stored, so that a row keeps its number from here to the end.
    stored = materialise(packed.mapInArrow(released(run), schema), "lm-scores").withColumn("row", F.monotonically_increasing_id())
    rare = counts.select(F.xxhash64("word").alias("word"), "n")
    joined = (
        stored.select("row", F.explode("others").alias("word"))
        .join(rare, "word")
        .groupBy("row")
        .agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count(F.lit(1)).alias("n_more"))
    )
    total = n_tokens + n_words + 1
    more, n_more = F.coalesce("more", F.lit(0.0)), F.coalesce("n_more", F.lit(0))
    return stored.join(joined, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + n_more).cast("bigint").alias("n_known"),
        F.lit(n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * float(np.log10(total))).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
