"""Quality rules by tokeniser fertility.

Public vocabularies that were learned on ordinary text split it into few, varied
tokens. Symbols, shouting, encoded data or text in a wrong language fall apart into
short tokens, into single bytes, or into the same few tokens. Measured per document:

* chars_per_token: code points of the words by their tokens,
* letters_per_token: the same without ASCII digits and punctuation, as a long run of
  one symbol is a single token and so looks cheap,
* byte_share: tokens that stand for one byte the vocabulary has no piece for,
* token_entropy: bits of the document's distribution of tokens.

Each group (the language, or the dominant script where it is null) has a band around
its own typical values, taken from all its documents by exact histograms. A short
text's values vary more, so its bands are wider.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custspark.llm.common import Measure, column, extend, raw_texts
from custspark.session import materialise

#: Words whose tokens a task keeps.
CACHE_WORDS = 150_000

# White space that ends a word, and characters counted as symbols.
SPACE = b"\x20\t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


@dataclass(frozen=True)
class Bands:
    """How far a document may be from its group's typical values.

    chars_per_token: from `low` to `high` times the group's median; letters_per_token: at
    least `letters` times its median; token_entropy: at
    least `entropy` times the smaller of the group's median and the most that so many
    tokens can have; byte_share: at most the group's median plus `bytes`. `spread`
    widens them all for a text of n tokens by 1 + spread / sqrt(n).
    """

    low: float = 0.82
    high: float = 1.35
    letters: float = 0.66
    entropy: float = 0.6
    bytes: float = 0.10
    spread: float = 4.0


@dataclass(frozen=True)
class BaseRules:
    """Rejected: fewer words than min_words, or a larger percentage in repeated windows."""

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class WordTokens:
    """Tokens of single words."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.kind = np.uint16 if len(self.is_byte) <= 1 << 16 else np.uint32

    def of(self, docs: list[list[bytes]], kept: dict[bytes, bytes]) -> list[np.ndarray]:
        """The ids of each document's words; `kept` has those of words met before, as bytes."""
        if len(kept) > CACHE_WORDS:
            kept.clear()
        new = [w for w in set(chain.from_iterable(docs)) if w not in kept]
        for low in range(0, len(new), 10_000):
            part = new[low : low + 10_000]
            coded = self.model.encode([w.decode() for w in part], num_threads=1)
            kept.update(zip(part, [np.array(c, self.kind).tobytes() for c in coded]))
        return [np.frombuffer(b"".join([kept[w] for w in words]), self.kind) for words in docs]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def entropy(ids: np.ndarray) -> float:
    """Bits; 0 without tokens."""
    if not len(ids):
        return 0.0
    n = np.bincount(ids)
    p = n[n > 0] / len(ids)
    return float(-(p * np.log2(p)).sum()) + 0.0


def script(text: str) -> str:
    """The script of most letters, by the first word of their names; 'none' without letters."""
    found: Counter[str] = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            found[unicodedata.name(c, "UNKNOWN").split(" ")[0].lower()] += n
    return min(found, key=lambda s: (-found[s], s)) if found else "none"


def repeated_words(words: list[bytes], window: int) -> int:
    """Words inside any window of so many words that the text has twice or more."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    width = 1
    while width < window:  # ranks of runs of `width` words give those of up to twice as many
        step = min(width, window - width)
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        _, rank = np.unique(pair, return_inverse=True)
        width += step
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_tokens bigint, chars_per_token double, letters_per_token double, byte_share double, token_entropy double, script string"
)


def measure(
    docs: DataFrame,
    keep: list[str],
    path: str | None = None,
    rules: BaseRules = BaseRules(),
    text_col: str = "text",
    by_script: Column | None = None,
) -> DataFrame:
    """Struct ``row`` of the columns kept, and the measures; a null text has no words.

    The script is null where ``by_script`` is not true.
    """
    where = path or default_vocabulary()
    wanted = "by_script"
    while wanted in docs.columns:
        wanted += "_"
    docs = docs.withColumn(wanted, F.lit(True) if by_script is None else by_script)

    def start() -> Measure:
        tokens = word_tokens(where)
        kept: dict[bytes, bytes] = {}  # of this task alone

        def each(scripts: pa.Array, texts: pa.Array) -> list[pa.Array]:
            raws = raw_texts(texts)
            docs = [raw.split() for raw in raws]
            ids = tokens.of(docs, kept)
            lines = [[x for x in raw.split(b"\n") if x.strip(SPACE)] for raw in raws]
            chars = [len(raw.translate(None, SPACE + _CONTINUED)) for raw in raws]
            letters = [len(raw.translate(None, _NO_LETTERS + _CONTINUED)) for raw in raws]
            counts = [len(i) for i in ids]
            numbers = (
                [len(w) for w in docs],
                chars,
                [len(raw) - len(raw.translate(None, SYMBOLS)) for raw in raws],
                [len(x) - len(set(x)) for x in lines],
                [repeated_words(w, rules.window) for w in docs],
                counts,
            )
            shares = (
                [c / n if n else 0.0 for c, n in zip(chars, counts)],
                [c / n if n else 0.0 for c, n in zip(letters, counts)],
                [float(tokens.is_byte[i].mean()) if len(i) else 0.0 for i in ids],
                [entropy(i) for i in ids],
            )
            return [
                *(pa.array(x, pa.int64()) for x in numbers),
                *(pa.array(x, pa.float64()) for x in shares),
                pa.array(
                    [script(raw.decode("utf-8", "ignore")) if s else None for raw, s in zip(raws, scripts.to_pylist())],
                    pa.string(),
                ),
            ]

        return each

    return extend(docs, start, FIELDS, keep, wanted, text_col)


def _median(measured: DataFrame, name: str, step: float) -> DataFrame:
    """The median of each group, to a step, over documents of at least 20 tokens: counts per bin, never sorted rows."""
    bins = (
        measured.filter("n_tokens >= 20")
        .groupBy("group", F.floor(F.col(name) / step).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return bins.groupBy("group").agg(
        F.expr("percentile(bin, 0.5D, n)").alias("bin")
    ).select("group", ((F.col("bin") + 0.5) * step).alias(f"typical_{name}"))


def verdict(measured: DataFrame, group: Column, bands: Bands = Bands(), rules: BaseRules = BaseRules()) -> DataFrame:
    """The measures and base_failed, band_failed (the failing band's name, or null), kept.

    ``measured`` must be a stored table, as it is read twice. A group too small to have
    typical values (no document of 20 tokens) fails nothing.
    """
    measured = measured.withColumn("group", group)
    typical = _median(measured, "chars_per_token", 0.01)
    for name, step in (("letters_per_token", 0.01), ("byte_share", 0.005), ("token_entropy", 0.05)):
        typical = typical.join(_median(measured, name, step), "group")
    # Written, so that its size is known: a row for each group, which Spark then broadcasts and no language is dealt out by key.
    judged = measured.join(materialise(typical, "fertility-bands"), "group", "left")
    wide = F.lit(1.0) + bands.spread / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)))
    ratio = F.col("chars_per_token") / F.col("typical_chars_per_token")
    letters = F.col("letters_per_token") / F.col("typical_letters_per_token")
    most = F.least(F.col("typical_token_entropy"), F.log2(F.greatest(F.col("n_tokens"), F.lit(1))))
    failed = (
        F.when(ratio < 1 - (1 - bands.low) * wide, "chars_per_token_low")
        .when(ratio > 1 + (bands.high - 1) * wide, "chars_per_token_high")
        .when(letters < 1 - (1 - bands.letters) * wide, "letters_per_token_low")
        .when(F.col("byte_share") > F.col("typical_byte_share") + bands.bytes * wide, "byte_share")
        .when(F.col("token_entropy") * wide < bands.entropy * most, "token_entropy")
    )
    base = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    return judged.withColumn("base_failed", base).withColumn("band_failed", failed).withColumn(
        "kept", ~base & failed.isNull()
    )


def judge(
    docs: DataFrame,
    keep: list[str],
    path: str | None = None,
    bands: Bands = Bands(),
    rules: BaseRules = BaseRules(),
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Struct ``row`` of the columns kept, with measures and verdict of each document.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged
    alike; an empty table gives no row. A missing language column, or a null in it, groups by script.
    """
    carried = [*dict.fromkeys([*keep, *([lang_col] if lang_col in docs.columns else [])])]
    unknown = column(docs, lang_col).isNull() if lang_col in docs.columns else None
    measured = materialise(measure(docs, carried, path, rules, text_col, unknown), "fertility")
    by_script = F.concat(F.lit("script:"), F.col("script"))
    if lang_col in docs.columns:
        group = F.coalesce(F.concat(F.lit("lang:"), column_of_row(lang_col)), by_script)
    else:
        group = by_script
    return verdict(measured, group, bands, rules)


def column_of_row(name: str) -> Column:
    return F.col("row").getField(name).cast("string")


def filtered(docs: DataFrame, **options: object) -> DataFrame:
    """The documents that are kept, with their own columns."""
    judged = judge(docs, docs.columns, **options)
    return judged.filter("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
